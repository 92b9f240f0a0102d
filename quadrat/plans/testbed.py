"""Models made of the test tables by fixed rules, so that any engine can make the same ones.

E: users as sites, event types as species, from events. B: customers as sites, brands as species, from the
sales tables. G: vectors as points, from embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS_E = ((0, 10), (1, 7))
FACTORS = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of a low-cardinality column and their place in order. Kept: a few rows that many plans need."""
    return (df.select(col).distinct().withColumn(name, (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))).persist()


class E:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ev = read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.hour("ts").alias("hour"))
        cells = ev.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg"))
        kinds = _rank(cells, "event_type", "species")
        site = F.col("user_id").alias("site")
        family = (F.col("species") % 3 + 1).cast("int")
        y = F.when(family == 1, F.col("avg") / 100).when(family == 2, (F.col("avg") > 50).cast("double")).otherwise(F.col("n").cast("double"))
        self.species = kinds.select("species", family.alias("family"), (1 + (F.col("species") % 3) * 0.25).cast("double").alias("sigma"))
        self.y = cells.join(kinds, "event_type").select(site, "species", family.alias("family"), F.when((F.col("user_id") + F.col("species")) % 7 != 0, y).alias("y"))
        by_user = ev.groupBy("user_id").agg(F.avg("hour").alias("h"))
        self.x = by_user.select(site, F.explode(F.array(F.struct(F.lit(0).alias("cov"), F.lit(1.0).alias("x")), F.struct(F.lit(1).alias("cov"), ((F.col("h") - 12) / 6).alias("x")))).alias("c")).select("site", "c.cov", "c.x")
        self.pi = by_user.select(site, F.explode(F.array(*[F.struct(F.lit(r).alias("level"), (F.col("user_id") % n).cast("int").alias("unit")) for r, n in LEVELS_E])).alias("c")).select("site", "c.level", "c.unit")
        self.beta = grid(self.species.select("species"), "cov", 2).select("cov", "species", (((F.col("cov") * 3 + F.col("species") * 2) % 5 - 2) / 4).alias("v"))
        self.units = spark.createDataFrame([(r, u) for r, n in LEVELS_E for u in range(n)], "level int, unit int")
        self.eta = scores(self.units)
        self.lam = loadings(self.species, 2)


class B:
    """Counts of lines per customer and brand on the full grid: brands are few, so the grid is customers times a broadcast list."""

    COVS = 6

    def __init__(self, spark: SparkSession, sf_dir: str):
        part, orders, customer, lines = (read(spark, sf_dir, t) for t in ("part", "orders", "customer", "lineitem"))
        brands = _rank(part, "p_brand", "species")
        self.species = brands.select("species", (0.5 + (F.col("species") % 4) * 0.25).alias("sigma"))
        per = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        per = per.groupBy("o_custkey", "p_brand").agg(F.count("*").alias("n")).join(brands, "p_brand").select(F.col("o_custkey").alias("site"), "species", "n")
        sites = customer.select(F.col("c_custkey").alias("site"))
        # a site's counts are one row until the brands meet them: nothing of the full grid is shuffled
        counts = per.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("species", "n"))).alias("ns"))
        full = sites.join(counts, "site", "left").crossJoin(brands.select("species"))
        self.y = full.select("site", "species", F.coalesce(F.col("ns")[F.col("species")].cast("double"), F.lit(0.0)).alias("y"))
        segments = _rank(customer, "c_mktsegment", "seg")
        c = customer.join(segments, "c_mktsegment").select(F.col("c_custkey").alias("site"), "c_acctbal", "seg")
        cells = [F.struct(F.lit(0).alias("cov"), F.lit(1.0).alias("x")), F.struct(F.lit(1).alias("cov"), (F.col("c_acctbal") / 10000).alias("x"))]
        cells += [F.struct(F.lit(1 + k).alias("cov"), (F.col("seg") == k).cast("double").alias("x")) for k in range(1, 5)]
        self.x = c.select("site", F.explode(F.array(*cells)).alias("c")).select("site", "c.cov", "c.x")
        nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        home = customer.join(nation, "c_nationkey")
        self.pi = home.select(F.col("c_custkey").alias("site"), F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("c_nationkey").alias("unit")), F.struct(F.lit(1).alias("level"), F.col("n_regionkey").alias("unit")))).alias("c")).select("site", "c.level", "c.unit")
        of_brand = part.join(brands, "p_brand")
        means = of_brand.groupBy("species").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
        self.traits = means.select("species", F.explode(F.array(*[F.struct(F.lit(k).alias("trait"), t.cast("double").alias("t")) for k, t in enumerate((F.lit(1.0), F.col("size") / 50, F.col("price") / 2000))])).alias("c")).select("species", "c.trait", "c.t")
        kinds = of_brand.groupBy("species", "p_type").agg(F.count("*").alias("n"))
        modal = kinds.groupBy("species").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_type")).alias("m"))
        self.taxonomy = modal.select("species", F.explode(F.array(F.struct(F.lit(0).alias("rank"), (F.col("species") % 5).cast("string").alias("taxon")), F.struct(F.lit(1).alias("rank"), F.col("m.p_type").alias("taxon")))).alias("c")).select("species", "c.rank", "c.taxon")
        self.beta = grid(self.species.select("species"), "cov", self.COVS).select("cov", "species", (((F.col("cov") * 3 + F.col("species") * 2) % 5 - 2) / 4).alias("v"))
        self.units = nation.select(F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("c_nationkey").alias("unit")), F.struct(F.lit(1).alias("level"), F.col("n_regionkey").alias("unit")))).alias("c")).select("c.level", "c.unit").distinct()
        self.eta = scores(self.units)
        self.lam = loadings(self.species, 2)
        gamma = grid(grid(spark.range(1).select(F.lit(0).alias("one")), "cov", self.COVS), "trait", 3)
        self.gamma = gamma.select("cov", "trait", (((F.col("cov") + F.col("trait") * 2) % 3 - 1) / 5).alias("v"))
        self.iv = grid(grid(spark.range(1).select(F.lit(0).alias("one")), "c1", self.COVS), "c2", self.COVS).select("c1", "c2", F.when(F.col("c1") == F.col("c2"), 2.0).otherwise(0.1).alias("v"))
        # standardised responses with every seventh missing
        seen = (F.col("site") + F.col("species")) % 7 != 0
        self.cells = self.y.join(self.species, "species").select("site", "species", F.when(seen, F.col("y") / 10).alias("z"), F.when(seen, 1 / (F.col("sigma") * F.col("sigma"))).otherwise(0.0).alias("id"))


class G:
    def __init__(self, spark: SparkSession, sf_dir: str):
        e = read(spark, sf_dir, "embeddings")
        d = lambda k: F.col("embedding")[k].cast("double")
        self.units = e.select(F.col("vec_id").alias("i"), F.array(d(0), d(1)).alias("p"))
        self.knots = e.groupBy("label").agg(F.array(F.avg(d(0)), F.avg(d(1))).alias("p")).select(F.col("label").alias("j"), "p")
        self.eta = e.select(F.col("vec_id").alias("unit"), F.explode(F.array(*[F.struct(F.lit(h).alias("h"), d(2 + h).alias("v")) for h in range(2)])).alias("c")).select("unit", "c.h", "c.v")
        self.grid = spark.createDataFrame([(0, 0.0, 0.4), (1, 0.05, 0.2), (2, 0.2, 0.2), (3, 1.0, 0.2)], "g int, alpha double, pw double")


def grid(df: DataFrame, axis: str, n: int) -> DataFrame:
    """Each row n times, with the numbers from 0."""
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def scores(units: DataFrame) -> DataFrame:
    return grid(units, "h", FACTORS).select("level", "unit", "h", (((F.col("unit") * 7 + F.col("h") * 3 + F.col("level") * 5) % 11 - 5) / 5).alias("v"))


def loadings(species: DataFrame, levels: int) -> DataFrame:
    cells = grid(grid(species.select("species"), "level", levels), "h", FACTORS)
    return cells.select("level", "h", "species", (((F.col("species") * 5 + F.col("h") * 3 + F.col("level") * 2) % 7 - 3) / 10).alias("v"))


def local_precisions(lam: DataFrame) -> DataFrame:
    return lam.select("level", "h", "species", (1 + (F.col("h") + F.col("species")) % 3 * 0.5).cast("double").alias("v"))


def global_precisions(lam: DataFrame) -> DataFrame:
    return lam.select("level", "h").distinct().select("level", "h", (1 + F.col("h") * 0.5 + F.col("level") * 0.25).cast("double").alias("v"))
