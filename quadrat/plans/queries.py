"""Named queries over the test beds: each puts one or more operators to work on whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.scalar import draw_of, rounded, recorded
from quadrat.functions.tensor import contract, densify, split, stack
from quadrat.functions import draws
from quadrat.operators import covariance, dense, design, eigen, predictive, scores, solve, spatial, statistics
from quadrat.plans.fit import effective_size, fit, r_hat, sequence_effective_size, summary
from quadrat.plans.testbed import FACTORS, B, E, G, global_precisions, grid, loadings, local_precisions, read
from quadrat.sources import draws as draw_files
from quadrat.sources import csv, model_json, model_parts
from quadrat.sources.state import folder, kept


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


def y_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return _round(E(spark, d).y.select("site", "species", "y", F.col("y").isNotNull().alias("observed")), "y")


def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _round(B(spark, d).x, "x")


def trait_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _round(B(spark, d).traits, "t")


def linear_predictor(spark: SparkSession, d: str) -> DataFrame:
    e = E(spark, d)
    return _round(design.predictor(e.x, e.beta, e.pi, e.eta, e.lam), "l")


def _e_cells(e: E) -> DataFrame:
    return e.y.join(design.predictor(e.x, e.beta, e.pi, e.eta, e.lam), ["site", "species"]).join(e.species.select("species", "sigma"), "species")


def z_augment_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(statistics.augmentation(_e_cells(E(spark, d))), "id", "pg_mean", "pg_sd", "mu", "s2", digits=5)


def sigma_gamma_params(spark: SparkSession, d: str) -> DataFrame:
    cells = _e_cells(E(spark, d)).withColumnRenamed("y", "z")
    return _round(statistics.residual_precision(cells, F.lit(1.0), F.lit(5.0)), "shape", "rate", digits=4)


def beta_normal_equations(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    return _round(statistics.normal_equations(b.x, list(range(b.COVS)), b.cells), "v", digits=3)


def gamma_v_scatter(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    e = statistics.coefficient_residuals(b.beta, b.gamma, b.traits)
    a = statistics.self_product(e, "cov", ["species"]).select(F.lit("A").alias("part"), F.col("cov1").alias("i"), F.col("cov2").alias("j"), "v")
    tt = statistics.self_product(b.traits, "trait", ["species"], "t").select(F.lit("TT").alias("part"), F.col("trait1").alias("i"), F.col("trait2").alias("j"), "v")
    bt = contract(b.beta, b.traits, ["species"], ["cov", "trait"], vb="t").select(F.lit("BT").alias("part"), F.col("cov").alias("i"), F.col("trait").alias("j"), "v")
    return _round(a.unionByName(tt).unionByName(bt), "v")


def eta_scatter(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    by_unit = contract(b.eta, b.lam, ["level", "h"], ["level", "unit", "species"])
    cells = statistics.residuals_at_cells(design.at_cells(b.cells, b.x, b.beta, b.pi, by_unit))
    return _round(statistics.score_statistics(cells, b.lam), "v", digits=4)


def eta_common_flag(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    return statistics.common_precision(b.pi, b.pi.select("level", "site").join(b.cells, "site"))


def loading_prior_precision(spark: SparkSession, d: str) -> DataFrame:
    lam = B(spark, d).lam
    return _round(statistics.loading_precision(local_precisions(lam), global_precisions(lam)), "prec")


def _shrinkage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lam = B(spark, d).lam
    constants = spark.createDataFrame([(r, 3.0, 50.0, 1.0, 50.0, 1.0) for r in range(2)], "level int, nu double, a1 double, b1 double, a2 double, b2 double")
    return statistics.shrinkage(lam, local_precisions(lam), global_precisions(lam), constants)


def shrinkage_local_params(spark: SparkSession, d: str) -> DataFrame:
    return _round(_shrinkage(spark, d)[0], "a_psi", "b_psi")


def shrinkage_global_params(spark: SparkSession, d: str) -> DataFrame:
    return _round(_shrinkage(spark, d)[1], "tau", "m", "ad", "bd")


def _sparse_loadings(spark: SparkSession, d: str) -> DataFrame:
    return B(spark, d).lam.withColumn("v", F.when((F.col("level") == 1) & (F.col("h") == 2), 0.0).otherwise(F.col("v")))


def nf_redundancy(spark: SparkSession, d: str) -> DataFrame:
    bounds = spark.createDataFrame([(0, 2, 5), (1, 2, 5)], "level int, nf_min int, nf_max int")
    return _round(statistics.factor_action(_sparse_loadings(spark, d), bounds, 30), "share")


def nf_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Factors that stay after dropping, numbered again, with a new empty one after them."""
    lam = B(spark, d).lam
    keep = lam.filter("not (level = 0 and h = 1)").withColumn("h", densify(["level", "species"], "h"))
    new = keep.select("level", "species", F.lit(0).alias("h"), F.lit(0.0).alias("v")).distinct()
    return stack([(keep, 0), (new, 3)], "h").select("level", "h", "species", "v")


SELECTIONS = ((0, (1,), 2, 0.3), (1, (2, 3), 3, 0.6))  # selection, covariates, groups, prior


def _selection(spark: SparkSession, b: B):
    groups = spark.createDataFrame([(s, c) for s, cs, _, _ in SELECTIONS for c in cs], "sel int, cov int")
    prior = spark.createDataFrame([(s, g, q) for s, _, n, q in SELECTIONS for g in range(n)], "sel int, grp int, q double")
    species = b.species.select("species", F.explode(F.array(*[F.struct(F.lit(s).alias("sel"), (F.col("species") % n).cast("int").alias("grp")) for s, _, n, _ in SELECTIONS])).alias("c")).select("c.sel", "species", "c.grp")
    active = prior.select("sel", "grp", ((F.col("sel") + F.col("grp")) % 2 == 0).alias("active"))
    return groups, species, active, prior, grid(spark.range(1).select(F.lit(0).alias("one")), "cov", b.COVS).select("cov")


def selection_mask(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    groups, species, active, _, covs = _selection(spark, b)
    return design.selection_mask(covs, species, groups, active)


def effective_design(spark: SparkSession, d: str) -> DataFrame:
    """Sums over sites of the design that each species sees."""
    b = B(spark, d)
    groups, species, active, _, covs = _selection(spark, b)
    eff = design.effective_design(b.x, design.selection_mask(covs, species, groups, active))
    return _round(eff.groupBy("species", "cov").agg(F.sum("x").alias("x")), "x", digits=4)


def selection_loglik(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    groups, species, active, prior, covs = _selection(spark, b)
    parts = None
    for s, *_ in SELECTIONS:
        one = design.selection_mask(covs, species, groups.filter(F.col("sel") != s), active).select(F.lit(s).alias("sel"), "cov", "species", "mask")
        parts = one if parts is None else parts.unionByName(one)
    out = statistics.selection_odds(b.x, b.beta, b.cells.filter("id > 0"), parts, groups, species, prior)
    return _round(out, "ll0", "ll1", "p1", digits=3)


def _original(b: B) -> DataFrame:
    return b.pi.filter("level = 0").select("site", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("site") * (k + 2) % 7 - 3) / 3).alias("x")) for k in range(3)])).alias("c")).select("site", "c.k", "c.x")


def rrr_normal_equations(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    beta = split(b.beta, "cov", 4, 6).withColumnRenamed("cov", "h")
    left, right = statistics.reduced_rank_equations(_original(b), beta, b.cells.withColumnRenamed("z", "s"))
    return _round(left.unionByName(right.select("h", "k", F.lit(-1).alias("g"), F.lit(-1).alias("l"), "v")), "v", digits=4)


def rrr_design(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame([(h, k, (h + 1) * 0.5 - k * 0.25) for h in range(2) for k in range(3)], "h int, k int, v double")
    return _round(design.reduced_rank(_original(B(spark, d)), w), "x")


def gp_covariance_grid(spark: SparkSession, d: str) -> DataFrame:
    """Row sums of the correlation matrix at each range."""
    g = G(spark, d)
    return _round(dense.products(g.units, g.grid).select("g", "i", F.col("v").alias("w")), "w", digits=4)


def gpp_cross_covariance(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return _round(spatial.correlations(g.units, g.knots, g.grid), "w")


def gpp_knot_covariance(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return _round(spatial.correlations(g.knots.withColumnRenamed("j", "i"), g.knots, g.grid), "w")


def gpp_knot_inverse(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return _round(spatial.inverse_and_log_det(spatial.correlations(g.knots.withColumnRenamed("j", "i"), g.knots, g.grid)), "w", "log_det")


def knn_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _round(spatial.preceding_neighbours(G(spark, d).units, 5), "d")


def _nearest(g: G) -> DataFrame:
    near = spatial.preceding_neighbours(g.units, 1).select("i", "j", "d")
    return g.units.select("i").join(near, "i", "left")


def nngp_loglik_1nn(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return _round(spatial.one_neighbour_log_likelihood(_nearest(g), g.eta, g.grid), "ll", digits=3)


def nngp_weights(spark: SparkSession, d: str) -> DataFrame:
    g = G(spark, d)
    return _round(spatial.neighbour_weights(g.units, spatial.preceding_neighbours(g.units, 5), g.grid.select("g", "alpha")), "v")


def alpha_loglik_grid(spark: SparkSession, d: str) -> DataFrame:
    """Over points 0 to 9 as units, with equal correlation c off the diagonal: its inverse is known."""
    g = G(spark, d)
    labels = g.knots.select(F.col("j").alias("unit"))
    eta = grid(labels, "h", 2).select("unit", "h", (((F.col("unit") * 3 + F.col("h") * 2) % 7 - 3) / 2).alias("v"))
    n = labels.count()
    c = F.col("alpha") / (1 + F.col("alpha"))
    precision = labels.crossJoin(labels.withColumnRenamed("unit", "unit2")).crossJoin(g.grid)
    w = (F.when(F.col("unit") == F.col("unit2"), 1.0).otherwise(0.0) - c / (1 + (n - 1) * c)) / (1 - c)
    log_det = g.grid.select("g", "pw", ((n - 1) * F.ln(1 - c) + F.ln(1 + (n - 1) * c)).alias("log_det"))
    return _round(statistics.quadratic_log_likelihood(eta, precision.select("g", "unit", "unit2", w.alias("w")), log_det), "ll", "p")


def rho_loglik_grid(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    rotated = statistics.coefficient_residuals(b.beta, b.gamma, b.traits).withColumnRenamed("species", "j")
    eigen = b.species.select(F.col("species").alias("j"), ((F.col("species") + 1) / 13).alias("e"))
    rho = spark.range(11).select(F.col("id").cast("int").alias("g"), (F.col("id") / 10).alias("rho"), F.when(F.col("id") == 0, 0.5).otherwise(0.05).alias("pw"))
    return _round(statistics.rho_log_likelihood(rotated, eigen, b.iv, rho), "ll", "p", digits=4)


def taxonomic_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _round(spatial.similarity(B(spark, d).taxonomy), "c")


def draw_schedule(spark: SparkSession, d: str) -> DataFrame:
    """All events as iterations: those recorded after a transient phase, every eighth, and their draws."""
    it = F.col("event_id")
    return read(spark, d, "events").filter(recorded(it, 50, 8)).select(it.alias("iteration"), draw_of(it, 50, 8).alias("draw"))


def partition_cumcounts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = read(spark, d, "customer").select((F.col("c_custkey") % 8 + 1).cast("int").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return n.select("part", "n", F.sum("n").over(Window.orderBy("part")).alias("cum"))


def partition_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sites of the first k partitions."""
    part = F.col("c_custkey") % 8 + 1
    return read(spark, d, "customer").filter(part.between(1, 3)).select(F.col("c_custkey").alias("site"), part.cast("int").alias("part"))


def normalised_times(spark: SparkSession, d: str) -> DataFrame:
    """Seconds per iteration, log ratio to the first engine, and 100,000 iterations, of runs made of events."""
    runs = read(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.count("*").alias("iterations"))
    norm = runs.select("event_type", (F.col("total") / F.col("iterations")).alias("per_iteration"))
    first = norm.agg(F.min(F.struct("event_type", "per_iteration")).alias("f")).select(F.col("f.per_iteration").alias("base"))
    out = norm.crossJoin(F.broadcast(first)).select("event_type", "per_iteration", F.log10(F.col("per_iteration") / F.col("base")).alias("log_ratio"), (F.col("per_iteration") * 100000).alias("extrapolated"))
    return _round(out, "per_iteration", "log_ratio", "extrapolated", digits=4)


def predictor_by_unit_covariates(spark: SparkSession, d: str) -> DataFrame:
    """Random part of loadings that depend on a covariate of the unit, summed by level and species."""
    e = E(spark, d)
    lam = grid(e.lam, "k", 2).select("level", "h", "species", "k", (F.col("v") * (F.col("k") + 1)).alias("v"))
    cov = grid(e.units, "k", 2).select("level", "unit", "k", F.when(F.col("k") == 0, 1.0).otherwise(F.col("unit") / 10).alias("v"))
    ran = design.random_part_with_covariates(e.pi, e.eta, lam, cov)
    return _round(ran.groupBy("level", "species").agg(F.sum("v").alias("v")), "v", digits=4)


def _covariate_level(units: DataFrame, lam: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two covariates of each unit, 1 and a tenth of its number, and loadings that depend on them."""
    cov = grid(units, "c", 2).select("level", "unit", "c", F.when(F.col("c") == 0, 1.0).otherwise(F.col("unit") / 10).alias("v"))
    return cov, grid(lam, "c", 2).select("level", "h", "species", "c", (F.col("v") * (F.col("c") + 1)).alias("v"))


def eta_scatter_by_unit_covariates(spark: SparkSession, d: str) -> DataFrame:
    """Precision and linear part of the scores where loadings depend on covariates of the unit."""
    b = B(spark, d)
    cov, lam = _covariate_level(b.units, b.lam)
    by_unit = design.unit_part_with_covariates(b.eta, lam.withColumnRenamed("c", "k"), cov.withColumnRenamed("c", "k"))
    cells = statistics.residuals_at_cells(design.at_cells(b.cells, b.x, b.beta, b.pi, by_unit))
    return _round(statistics.score_statistics_with_covariates(cells, lam, cov), "v", digits=4)


def covariate_loadings_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Five draws of loadings with a covariates' axis, beside loadings without one, as JSON by chain and read back."""
    e = E(spark, d)
    _, lam = _covariate_level(e.units, e.lam)
    third = F.when(F.col("level") == 1, F.col("c"))  # level 0 has no covariates
    lam = lam.filter("level = 1 or c = 0").select(F.lit("Lambda").alias("param"), "level", F.col("h").alias("i"), F.col("species").alias("j"), third.alias("k"), "v")
    drawn = grid(lam, "draw", 5).select((F.col("draw") % 2).alias("chain"), "draw", "param", "level", "i", "j", "k", (F.col("v") + F.col("draw")).alias("v"))
    text = draw_files.to_json(drawn)
    plain = draw_files.from_json(text, True).withColumn("k", F.lit(None).cast("int"))
    return _round(draw_files.from_json(text, by_covariate=True).unionByName(plain), "v")


def _user_draws(spark: SparkSession, d: str) -> DataFrame:
    """All events as draws: a user's events, dealt to two chains by their number, in order."""
    ev = read(spark, d, "events")
    return ev.select(F.col("user_id").alias("param"), (F.col("event_id") % 2).cast("int").alias("chain"), F.col("event_id").alias("draw"), F.col("value").alias("v"))


def posterior_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(summary(_user_draws(spark, d), "param"), "mean", "sd", "q025", "median", "q975")


def posterior_r_hat(spark: SparkSession, d: str) -> DataFrame:
    return _round(r_hat(_user_draws(spark, d), "param"), "r_hat")


def posterior_ess(spark: SparkSession, d: str) -> DataFrame:
    return _round(effective_size(_user_draws(spark, d), "param"), "ess", digits=4)


def _event_draws(spark: SparkSession, d: str) -> DataFrame:
    """All events as draws: users by twos are the chains of a value of each event type, events in order its draws."""
    from pyspark.sql import Window

    ev = read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("param"), F.col("value").alias("v"))
    draw = F.row_number().over(Window.partitionBy("user_id", "param").orderBy("event_id"))
    return ev.select("param", F.floor(F.col("user_id") / 2).alias("i"), (F.col("user_id") % 2).cast("int").alias("chain"), draw.alias("draw"), "v")


def event_draws_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(summary(_event_draws(spark, d), "param", "i"), "mean", "sd", "q025", "median", "q975")


def event_draws_r_hat(spark: SparkSession, d: str) -> DataFrame:
    return _round(r_hat(_event_draws(spark, d), "param", "i"), "r_hat")


def event_draws_ess(spark: SparkSession, d: str) -> DataFrame:
    return _round(sequence_effective_size(_event_draws(spark, d), "param", "i"), "ess", digits=4)


def model_of(e: E):
    """Arrays of the normal and presence species of a bed, counts as logs: dense, as a chain needs them."""
    from quadrat.kernels.state import Level, Model

    y, x, pi = (t.toPandas() for t in (e.y, e.x, e.pi))
    sites = np.sort(x["site"].unique())
    at = lambda s: np.searchsorted(sites, s)
    ns = int(y["species"].max()) + 1
    Y, X, Pi = np.full((len(sites), ns), np.nan), np.zeros((len(sites), 2)), np.zeros((len(sites), 2), int)
    Y[at(y["site"]), y["species"]] = y["y"].to_numpy(float)
    X[at(x["site"]), x["cov"]] = x["x"]
    Pi[at(pi["site"]), pi["level"]] = pi["unit"]
    return Model(Y=Y, X=X, Pi=Pi, family=np.arange(ns) % 3 + 1, var_free=np.arange(ns) % 3 == 0, levels=[Level(nf_max=3), Level(nf_max=3)])


def gibbs_fit(spark: SparkSession, d: str) -> DataFrame:
    """Posterior means of two chains on the events model; random, so without an SQL counterpart."""
    return summary(fit(spark, model_of(E(spark, d)), chains=2, samples=20, transient=20, seed=1), "param", "level", "i", "j")


def _model_text(e: E) -> DataFrame:
    """The responses and design of a bed as a model's JSON text: one row, as such a file is one text."""
    def rows(df: DataFrame, axis: str, name: str) -> DataFrame:
        by = df.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, F.coalesce(F.col(name).cast("string"), F.lit("NA")).alias("v")))), lambda x: x["v"]).alias("r"))
        return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("site", "r"))), lambda x: x["r"]).alias(name))

    every = e.x.select("site").distinct().crossJoin(e.species.select("species")).join(e.y.select("site", "species", "y"), ["site", "species"], "left")
    both = rows(every, "species", "y").crossJoin(rows(e.x, "cov", "x"))
    one = lambda c: F.array(F.size(c))
    hm = F.struct(F.col("y").alias("YScaled"), F.col("x").alias("XScaled"), one(F.col("y")).alias("ny"), one(F.col("y")[0]).alias("ns"), one(F.col("x")[0]).alias("nc"), F.lit(2).alias("nr"))
    return both.select(F.to_json(F.struct(hm.alias("hM"))).alias("json"))


def model_file_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses written as a model's JSON text and read back, sites and species by their place."""
    text = _model_text(E(spark, d))
    return _round(model_json.matrix(text, "YScaled", "site", "species", "y"), "y")


def model_file_design(spark: SparkSession, d: str) -> DataFrame:
    return _round(model_json.matrix(_model_text(E(spark, d)), "XScaled", "site", "cov", "x"), "x")


def model_file_dims(spark: SparkSession, d: str) -> DataFrame:
    return model_json.dims(_model_text(E(spark, d))).select("ny", "ns", "nc", "nr")


def _parts(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def model_parts_cells(spark: SparkSession, d: str) -> DataFrame:
    """Responses, design, traits and units of a model of customers, written as lines by matrix and read back."""
    b, path = B(spark, d), _parts(spark, "model")
    species = b.y.select("site", "species", F.when((F.col("site") + F.col("species")) % 7 != 0, F.col("y")).alias("y"))
    model_parts.write_matrix(species, path, "YScaled", "site", "species", "y")
    model_parts.write_matrix(b.x, path, "XScaled", "site", "cov", "x")
    model_parts.write_matrix(b.traits, path, "TrScaled", "species", "trait", "t")
    model_parts.write_matrix(b.pi, path, "Pi", "site", "level", "unit", index=True)
    t = model_parts.tables(spark, path)
    parts = (("y", "site", "species", "y"), ("x", "site", "cov", "x"), ("traits", "species", "trait", "t"), ("pi", "site", "level", "unit"))
    rows = [t[k].select(F.lit(k).alias("part"), F.col(a).cast("bigint").alias("i"), F.col(c).cast("int").alias("j"), F.col(v).cast("double").alias("v")) for k, a, c, v in parts]
    return _round(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), "v")


def model_parts_dims(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of sites, species, covariates, traits and levels, from the lines of a model of users."""
    e, path = E(spark, d), _parts(spark, "model")
    model_parts.write_matrix(e.y, path, "YScaled", "site", "species", "y")
    model_parts.write_matrix(e.x, path, "XScaled", "site", "cov", "x")
    model_parts.write_matrix(e.pi, path, "Pi", "site", "level", "unit", index=True)
    return model_parts.dims(spark, path)


def model_parts_levels(spark: SparkSession, d: str) -> DataFrame:
    """Constants of the customers' levels, whose most factors follow from their units, written and read back."""
    path = _parts(spark, "model")
    units = B(spark, d).pi.groupBy("level").agg(F.countDistinct("unit").alias("n"))
    with_covariates = F.col("level") == 1
    constants = {"nu": F.lit(3.0), "a1": F.lit(50.0), "b1": F.lit(1.0), "a2": F.lit(50.0), "b2": F.lit(1.0), "nf_min": F.lit(2), "nf_max": F.col("n"), "s_dim": F.when(~with_covariates, 2), "x_dim": F.when(with_covariates, 2), "method": F.when(~with_covariates, "NNGP")}
    model_parts.write_levels(units.select("level", *[c.alias(n) for n, c in constants.items()]), path)
    return model_parts.levels(spark, path)


def model_parts_state(spark: SparkSession, d: str) -> DataFrame:
    """First states of two chains, loadings of one level by covariates, written and read back."""
    b, path = B(spark, d), _parts(spark, "model")
    _, lam = _covariate_level(b.units, b.lam)
    none = F.lit(None).cast("int")
    rows = [
        b.beta.select(F.lit("Beta").alias("param"), F.lit(-1).alias("level"), F.col("cov").alias("i"), F.col("species").alias("j"), none.alias("k"), "v"),
        b.eta.select(F.lit("Eta").alias("param"), "level", F.col("unit").alias("i"), F.col("h").alias("j"), none.alias("k"), "v"),
        lam.filter("level = 1 or c = 0").select(F.lit("Lambda").alias("param"), "level", F.col("h").alias("i"), F.col("species").alias("j"), F.when(F.col("level") == 1, F.col("c")).alias("k"), "v"),
        b.lam.select("level", "h").distinct().select(F.lit("Alpha").alias("param"), "level", F.col("h").alias("i"), F.lit(0).alias("j"), none.alias("k"), (F.col("h") * 2).cast("double").alias("v")),
    ]
    both = grid(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), "chain", 2).withColumn("v", F.col("v") + F.col("chain"))
    model_parts.write_state(both, path)
    return _round(model_parts.state(spark, path), "v")


def csv_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses as lines of a wide CSV table, a site each, and read back: of cells that are not there, and missing ones, NA."""
    e = E(spark, d)
    names = [f"sp{r.species}" for r in e.species.select("species").orderBy("species").collect()]
    seen = e.y.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("species", F.col("y").cast("string").alias("y")))).alias("m"))
    cells = [F.coalesce(F.col("m")[F.lit(k)], F.lit("NA")) for k in range(len(names))]
    lines = seen.select(F.concat_ws(",", F.col("site").cast("string"), *cells).alias("value"))
    got = csv.from_lines(lines, ["site", *names], "site", "species", "y")
    return _round(got.select(F.col("site").cast("long").alias("site"), "species", "y"), "y")


def log_density_terms(spark: SparkSession, d: str) -> DataFrame:
    b = B(spark, d)
    by_unit = contract(b.eta, b.lam, ["level", "h"], ["level", "unit", "species"])
    cells = design.at_cells(b.cells, b.x, b.beta, b.pi, by_unit).withColumn("l", F.coalesce("f", F.lit(0.0)) + design.total("owns"))
    precision = statistics.loading_precision(local_precisions(b.lam), global_precisions(b.lam))
    return _round(statistics.log_density_terms(cells, statistics.coefficient_residuals(b.beta, b.gamma, b.traits), b.iv, b.eta, b.lam, precision), "v", digits=3)


def _draws_of(e: E, chain: int) -> DataFrame:
    """A draws table made of coefficients and scores by a fixed rule: ten draws that drift."""
    drawn = grid(e.beta.select(F.lit("Beta").alias("param"), F.lit(-1).alias("level"), F.col("cov").alias("i"), F.col("species").alias("j"), "v"), "draw", 10)
    rho = e.beta.agg(F.count("*").alias("n")).select(F.lit("rho").alias("param"), F.lit(-1).alias("level"), F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("n") % 7).cast("double").alias("v"))
    scores = e.eta.select(F.lit("Eta").alias("param"), "level", F.col("unit").alias("i"), F.col("h").alias("j"), "v")
    moved = drawn.withColumn("v", F.col("v") + F.col("draw") / 10 + chain).unionByName(grid(rho, "draw", 10)).unionByName(grid(scores, "draw", 10).withColumn("v", F.col("v") * (1 + F.col("draw"))))
    return moved.select(F.lit(chain).alias("chain"), F.col("draw").cast("int").alias("draw"), "param", "level", "i", "j", "v")


def draws_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Draws of two results, merged, as JSON texts by chain and read back: with levels and without."""
    e = E(spark, d)
    text = draw_files.to_json(_draws_of(e, 0).unionByName(_draws_of(e, 1)), 1.5)
    return _round(draw_files.from_json(text).unionByName(draw_files.from_json(text, True)), "v")


def draws_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean of every parameter over the draws of two results."""
    e = E(spark, d)
    both = _draws_of(e, 0).unionByName(_draws_of(e, 1))
    return _round(summary(both, "param", "level", "i", "j").select("param", "level", "i", "j", "n", "mean", "sd", "median"), "mean", "sd", "median")


def nngp_weights_two(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two neighbours, which can be written out."""
    g = G(spark, d)
    return _round(spatial.neighbour_weights(g.units, spatial.preceding_neighbours(g.units, 2), g.grid.select("g", "alpha")), "v", digits=5)


def gpp_knot_identity(spark: SparkSession, d: str) -> DataFrame:
    """The knots' correlation by its inverse, at each range."""
    g = G(spark, d)
    w = spatial.correlations(g.knots.withColumnRenamed("j", "i"), g.knots, g.grid)
    inverse = spatial.inverse_and_log_det(w).select("g", F.col("i").alias("j"), F.col("j").alias("k"), "w")
    return _round(contract(w, inverse, ["g", "j"], ["g", "i", "k"], "w", "w"), "v", digits=4)


def rrr_prior_params(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the local and global precisions of reduced-rank weights of the traits: the same rule as for loadings."""
    w = B(spark, d).traits.select(F.lit(0).alias("level"), F.col("trait").alias("h"), "species", F.col("t").alias("v"))
    constants = spark.createDataFrame([(0, 3.0, 1.0, 1.0, 50.0, 1.0)], "level int, nu double, a1 double, b1 double, a2 double, b2 double")
    local, over = statistics.shrinkage(w, local_precisions(w), global_precisions(w), constants)
    rows = local.select("h", "species", F.col("a_psi").alias("a"), F.col("b_psi").alias("b"))
    return _round(rows.unionByName(over.select("h", F.lit(-1).alias("species"), F.col("ad").alias("a"), F.col("bd").alias("b"))), "a", "b", digits=5)


#: Of the queries that draw: seed, chain, iteration.
DRAWN = (20240607, 1, 17)


def z_draws(spark: SparkSession, d: str) -> DataFrame:
    """A draw of every latent response."""
    return _round(statistics.latent_responses(_e_cells(E(spark, d)), F.col("site") * 64 + F.col("species"), *DRAWN), "z", digits=5)


def alpha_draws(spark: SparkSession, d: str) -> DataFrame:
    """The range of each factor in 200 iterations of 2 chains, from its likelihood over all units."""
    g = G(spark, d)
    ll = spatial.one_neighbour_log_likelihood(_nearest(g), g.eta, g.grid)
    rows = grid(grid(ll, "chain", 2), "iteration", 200)
    # over so many units one range takes all: the likelihood is tempered to that of 20, so that several are drawn
    units = g.units.count()
    rows = rows.withColumn("ll", F.col("ll") * (20.0 / units))
    rows = draws.with_uniform(rows, "u", DRAWN[0], F.col("chain"), F.col("iteration"), F.col("h") * 64 + F.col("g"))
    return draws.categorical(rows, ["chain", "iteration", "h"], "g", "ll", "u")


def _joint(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The systems of all species' coefficients and loadings, and what the priors add."""
    b = B(spark, d)
    factor = (F.col("level") * FACTORS + F.col("h")).alias("factor")
    scores = b.pi.join(b.eta, ["level", "unit"]).select("site", factor, "v")
    precision = statistics.loading_precision(local_precisions(b.lam), global_precisions(b.lam)).select("species", factor, "prec")
    systems = statistics.joint_equations(b.x, list(range(b.COVS)), scores, list(range(2 * FACTORS)), b.cells)
    return systems, statistics.coefficient_priors(b.iv, b.gamma, b.traits, precision, b.COVS)


def _matrix_cells(systems: DataFrame, priors: DataFrame) -> DataFrame:
    """species, a, b, v of the whole matrix."""
    n = F.size("r")
    cells = systems.select("species", F.posexplode("p").alias("at", "v"), n.alias("n")).select("species", F.floor(F.col("at") / F.col("n")).cast("int").alias("a"), (F.col("at") % F.col("n")).cast("int").alias("b"), "v")
    return cells.unionByName(priors.filter("b >= 0").select("species", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "v")).groupBy("species", "a", "b").agg(F.sum("v").alias("v"))


def beta_lambda_mean(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients and loadings of each species solved for, and put back into its system: what comes out is the right side."""
    systems, priors = _joint(spark, d)
    mean = solve.posterior(systems, "species", priors, *DRAWN).select("species", F.posexplode("mean").alias("b", "v"))
    found = contract(_matrix_cells(systems, priors), mean, ["species", "b"], ["species", "a"])
    return _round(found.withColumn("v", F.col("v") * 2**0.5), "v", digits=4)  # by the root of 2: sums of short decimals lie halfway between rounded numbers


def beta_lambda_draws(spark: SparkSession, d: str) -> DataFrame:
    """How far a draw of each species' coefficients and loadings is from their mean, by their precision: the square of its noise."""
    systems, priors = _joint(spark, d)
    both = solve.posterior(systems, "species", priors, *DRAWN).select("species", F.posexplode(F.zip_with("draw", "mean", lambda x, m: x - m)).alias("a", "v"))
    left = contract(_matrix_cells(systems, priors), both, ["species", "a"], ["species", "b"])
    return _round(contract(left, both.withColumnRenamed("a", "b"), ["species", "b"], ["species"]), "v", digits=4)


def gpp_variances(spark: SparkSession, d: str) -> DataFrame:
    """What the knots leave of every unit's variance, at each range."""
    g = G(spark, d)
    return _round(predictive.left_variances(g.units, g.knots, g.grid), "dd", digits=5)


def gpp_information(spark: SparkSession, d: str) -> DataFrame:
    """The knot-sized matrix that stands for all units, at each range."""
    g = G(spark, d)
    found = predictive.information(g.units, g.knots, g.grid)
    return _round(found.withColumn("v", F.col("v") / 100), "v", digits=4)


def gpp_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Each factor's likelihood over all units by way of the knots, at each range."""
    g = G(spark, d)
    return _round(predictive.log_likelihood(g.units, g.knots, g.grid, g.eta), "log_det", "quad", "ll", digits=3)


def nngp_loglik_two(spark: SparkSession, d: str) -> DataFrame:
    """Each factor's likelihood over all units by two neighbours, at each range."""
    g = G(spark, d)
    weights = spatial.neighbour_weights(g.units, spatial.preceding_neighbours(g.units, 2), g.grid.select("g", "alpha"))
    return _round(spatial.sparse_log_likelihood(weights, g.eta, g.grid), "log_det", "quad", "ll", digits=3)


def gp_solution(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all units by the inverse of their full correlation, and by the correlation again: what comes out are the scores."""
    g = G(spark, d)
    x = dense.iterated(g.units, g.grid, g.eta)
    return _round(dense.products(g.units, g.grid, x.withColumnRenamed("unit", "i")), "v", digits=4)


def gp_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Each factor's likelihood over all units by their full correlation, at each range."""
    g = G(spark, d)
    return _round(dense.log_likelihood(dense.cholesky(dense.tiles(g.units, g.grid, g.eta, 256)), g.grid), "log_det", "quad", "ll", digits=3)


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells of eight components of each vector as responses, and their loadings on two factors."""
    e = read(spark, d, "embeddings")
    cells = e.select(F.col("vec_id").alias("unit"), F.posexplode(F.slice("embedding", 5, 8)).alias("species", "s")).select(F.lit(0).alias("level"), "unit", "species", F.col("s").cast("double").alias("s"), F.lit(4.0).alias("id"))
    lam = grid(grid(spark.range(1).select(F.lit(0).alias("level")), "h", 2), "species", 8)
    return cells, lam.select("level", "h", "species", (((F.col("species") * 5 + F.col("h") * 3) % 7 - 3) / 4).alias("v"))


def nngp_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of all units by two neighbours, by the precision again: what comes out is the right side."""
    g = G(spark, d)
    cells, lam = _observed(spark, d)
    weights = spatial.neighbour_weights(g.units, spatial.preceding_neighbours(g.units, 2), g.grid.filter("g = 1").select("g", "alpha"))
    found = statistics.score_statistics(cells, lam).drop("level")
    matrix = scores.precision(scores.rows_of_factors(weights, spark.createDataFrame([(0, 1), (1, 1)], "h int, g int")), found.filter("k >= 0"))
    matrix, right = kept(matrix, "precision"), found.filter("k < 0").select("unit", "h", "v")
    near = spatial.parts(g.units, 4096).select(F.col("i").alias("unit"), "part")
    x = scores.solve_by_parts(matrix, right, near, 1e-11).select(F.col("unit").alias("unit2"), F.col("h").alias("h2"), "v")
    return _round(contract(matrix, x, ["unit2", "h2"], ["unit", "h"]), "v", digits=4)


def delta_draws(spark: SparkSession, d: str) -> DataFrame:
    """Global precisions one after the other, with Gamma draws that are their shape times a rule of the factor."""
    constants = spark.createDataFrame([(r, 3.0, 50.0, 1.0, 50.0, 1.0) for r in range(2)], "level int, nu double, a1 double, b1 double, a2 double, b2 double")
    return _round(statistics.sequential_delta(_shrinkage(spark, d)[1], constants, F.col("ad") * (0.8 + F.col("h") * 0.3)), "v")


def _effects(b: B, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The system of the traits' effects, its prior, and both as cells."""
    n = 3 * b.COVS
    own = cells.sparkSession.range(n).select(F.lit(0).alias("model"), F.col("id").cast("int").alias("a"))
    prior = own.select("model", "a", F.col("a").alias("b"), F.lit(0.5).alias("v")).unionByName(own.select("model", "a", F.lit(-1).alias("b"), F.lit(0.1).alias("v")))
    return covariance.one_system(cells, n), prior, cells.unionByName(prior.drop("model"))


def _put_back(b: B, cells: DataFrame) -> DataFrame:
    systems, prior, every = _effects(b, cells)
    mean = solve.posterior(systems, "model", prior, *DRAWN).select(F.posexplode("mean").alias("b", "v"))
    return _round(contract(every.filter("b >= 0"), mean, ["b"], ["a"]).withColumn("v", F.col("v") * 2**0.5), "v", digits=4)


def gamma_mean(spark: SparkSession, d: str) -> DataFrame:
    """The traits' effects solved for and put back into their system: what comes out is the right side."""
    b = B(spark, d)
    return _put_back(b, covariance.effect_cells(b.beta, b.traits, b.iv, b.COVS))


def gamma_draws(spark: SparkSession, d: str) -> DataFrame:
    """How far a draw of the traits' effects is from their mean, by their precision: the square of its noise."""
    b = B(spark, d)
    systems, prior, every = _effects(b, covariance.effect_cells(b.beta, b.traits, b.iv, b.COVS))
    far = solve.posterior(systems, "model", prior, *DRAWN).select(F.posexplode(F.zip_with("draw", "mean", lambda x, m: x - m)).alias("a", "v"))
    left = contract(every.filter("b >= 0"), far, ["a"], ["b"])
    return _round(contract(left, far.withColumnRenamed("a", "b").withColumn("model", F.lit(0)), ["b"], ["model"]), "v", digits=4)


def iv_draws(spark: SparkSession, d: str) -> DataFrame:
    """The covariates' precision drawn: its trace with the inverse scale and the log of its determinant, which the draw's triangle gives as well."""
    b = B(spark, d)
    prior = b.iv.select(F.col("c1").alias("cov1"), F.col("c2").alias("cov2"), "v")
    scale = statistics.self_product(statistics.coefficient_residuals(b.beta, b.gamma, b.traits), "cov", ["species"]).unionByName(prior)
    scale = scale.groupBy("cov1", "cov2").agg(F.sum("v").alias("v")).select(F.col("cov1").alias("c1"), F.col("cov2").alias("c2"), "v")
    w = covariance.wishart(scale, 7 + b.species.count(), b.COVS, *DRAWN)
    trace = w.join(scale.withColumnRenamed("v", "s"), ["c1", "c2"]).agg(F.sum(F.col("v") * F.col("s")).alias("v")).select(F.lit("trace").alias("term"), "v")
    return _round(trace.unionByName(covariance.log_determinant(w, F.lit(0), b.COVS).select(F.lit("log_det").alias("term"), "v")), "v", digits=5)


def _by_eigenvectors(spark: SparkSession, d: str, block: int | None = None) -> tuple[B, DataFrame, DataFrame]:
    b = B(spark, d)
    values, vectors = eigen.decompose(spatial.similarity(b.taxonomy).select(F.col("sp1").alias("i"), F.col("sp2").alias("j"), F.col("c").alias("v")), block)
    return b, values, vectors.withColumnRenamed("i", "species")


def _rotated(rows: DataFrame, vectors: DataFrame, axis: str, value: str = "v") -> DataFrame:
    return contract(rows, vectors, ["species"], [axis, "j"], va=value, name=value)


def similarity_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The species' similarity made again of its eigenvalues and eigenvectors."""
    _, values, vectors = _by_eigenvectors(spark, d, 8)
    one = vectors.join(values, "j").select("j", F.col("species").alias("sp1"), (F.col("v") * F.col("e")).alias("v"))
    return _round(contract(one, vectors.withColumnRenamed("species", "sp2"), ["j"], ["sp1", "sp2"], name="c"), "c")


def rho_loglik_rotated(spark: SparkSession, d: str) -> DataFrame:
    """The likelihood of the phylogeny's share over a grid, of residuals in the base of the similarity's eigenvectors."""
    b, values, vectors = _by_eigenvectors(spark, d)
    rho = spark.range(11).select(F.col("id").cast("int").alias("g"), (F.col("id") / 12).alias("rho"), F.when(F.col("id") == 0, 0.5).otherwise(0.05).alias("pw"))
    rotated = _rotated(statistics.coefficient_residuals(b.beta, b.gamma, b.traits), vectors, "cov")
    return _round(statistics.rho_log_likelihood(rotated, values, b.iv, rho), "ll", "p", digits=4)


def gamma_mean_phylogeny(spark: SparkSession, d: str) -> DataFrame:
    """As gamma_mean, where species are alike by their phylogeny: in the base of its eigenvectors, at a share of one half."""
    b, values, vectors = _by_eigenvectors(spark, d)
    scales = covariance.phylogenetic_scales(values, b.beta.select("cov").distinct().withColumn("rho", F.lit(0.5)))
    beta, traits = (_rotated(x, vectors, axis, v).withColumnRenamed("j", "species") for x, axis, v in ((b.beta, "cov", "v"), (b.traits, "trait", "t")))
    return _put_back(b, covariance.effect_cells(beta, traits, b.iv, b.COVS, scales))


def integrated_density(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the target of Hamiltonian moves: loadings without local precisions, scores of all units without their range."""
    g, lam = G(spark, d), B(spark, d).lam
    constants = spark.createDataFrame([(r, 3.0) for r in range(2)], "level int, nu double")
    ll = spatial.one_neighbour_log_likelihood(_nearest(g), g.eta, g.grid)
    return _round(statistics.integrated_density_terms(lam, global_precisions(lam), constants, ll), "v", digits=3)


QUERIES = {
    f.__name__: f
    for f in (
        y_matrix_long, design_matrix, trait_matrix, linear_predictor, z_augment_stats, sigma_gamma_params, beta_normal_equations, gamma_v_scatter, eta_scatter, eta_common_flag,
        loading_prior_precision, shrinkage_local_params, shrinkage_global_params, nf_redundancy, nf_reindex, selection_mask, effective_design, selection_loglik, rrr_normal_equations, rrr_design,
        gp_covariance_grid, gpp_cross_covariance, gpp_knot_covariance, gpp_knot_inverse, knn_neighbours, nngp_loglik_1nn, nngp_weights, alpha_loglik_grid, rho_loglik_grid, taxonomic_similarity,
        draw_schedule, partition_cumcounts, partition_rows, normalised_times, predictor_by_unit_covariates, posterior_summary, posterior_r_hat, posterior_ess, gibbs_fit,
        model_file_responses, model_file_design, model_file_dims, draws_json_round_trip, draws_summary, nngp_weights_two, gpp_knot_identity, rrr_prior_params,
        event_draws_summary, event_draws_r_hat, event_draws_ess, csv_responses, log_density_terms,
        z_draws, alpha_draws, beta_lambda_mean, beta_lambda_draws, gpp_variances, gpp_information, gpp_loglik, nngp_loglik_two, gp_solution, gp_loglik, nngp_scores, delta_draws,
        gamma_mean, gamma_draws, iv_draws, similarity_rebuilt, rho_loglik_rotated, gamma_mean_phylogeny, integrated_density,
        eta_scatter_by_unit_covariates, covariate_loadings_json_round_trip, model_parts_cells, model_parts_dims, model_parts_levels, model_parts_state,
    )
}
