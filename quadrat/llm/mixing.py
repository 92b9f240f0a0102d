"""Mixing sources to target weights with nested hash-threshold histograms.

Every document has a 32-bit hash of its id. By source, word counts are summed into buckets of the hash's
top bits; the bucket in which a source's budget runs out is refined by the next bits, twice, and no other
bucket is looked at again. What remains is one threshold per source: a document is taken once more where
its hash is at most the threshold. No sort of documents, no random state: reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; documents of
equal id (or equal hash) share their fate; an empty table, or one without words, gives targets of 0.
The distance between a source's taken words and its target is at most half of the size of the documents
that share the hash at the threshold. A very long text is counted whole and taken or left as one. Only id, source and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Shifts and widths of the three nested histograms of the 32-bit hash: at most 2,048 rows per source each.
LEVELS = ((21, 11), (10, 11), (0, 10))


def id_hash(doc_id: Column) -> Column:
    """The first 32 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
        id_hash(F.col(doc_id)).alias("h"),
    )


def targets(sizes: DataFrame, share: float = 1.5, weights=(5, 2, 1), cap: float = 2.0) -> DataFrame:
    """source, source_size, target: shares by weight, levelled so that none is above its cap.

    With w the weights and c the caps, the targets are min(c, w L) for the one L that spends the whole
    budget. L is the largest of the levels that follow from taking the j sources with the least c / w as
    capped, j = 0, 1, ...: windows over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank - 1) % len(weights) + 1)
    s = by_source.select("source", "source_size", w.alias("w"), (F.lit(cap) * F.col("source_size")).alias("c"))
    before = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.least("c", F.col("w") * F.col("level")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies of every document), cut (hash up to which one more is taken)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    state = goals.select("source", "source_size", "target", whole.alias("whole"))
    state = state.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("top", F.lit(0).cast("long"))
    for shift, width in LEVELS:
        at = state.select(F.col("source").alias("_s"), F.col("top").alias("_top"), F.col("left").alias("_left"))
        inside = sizes.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + width) == F.col("_top")) & (F.col("_left") > 0))
        grown = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("_left").alias("left"))
        up_to = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        # the bucket in which the budget ends: the first that is more than it; at the last level, nearer counts
        over = grown.withColumn("up_to", up_to).withColumn("start", F.col("up_to") - F.col("size"))
        fits = F.col("up_to") <= F.col("left")
        if not shift:
            fits = fits | ((F.col("start") <= F.col("left")) & (F.col("up_to") - F.col("left") <= F.col("left") - F.col("start")))
        edge = over.filter(~fits).groupBy(F.col("source").alias("_s")).agg(F.min(F.struct("bucket", "start")).alias("edge"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source",
            "source_size",
            "target",
            "whole",
            (F.col("left") - F.coalesce("edge.start", F.lit(0))).alias("left"),
            # where nothing is left over, or the whole budget fits, the threshold stays at that bucket's end
            F.coalesce("edge.bucket", F.when(F.col("left") > 0, F.shiftleft(F.col("top") + 1, width)).otherwise(F.shiftleft("top", width))).alias("top"),
        )
    return state.select("source", "source_size", "target", "whole", F.col("top").alias("cut"))


def mix(docs: DataFrame, *, share: float = 1.5, weights=(5, 2, 1), cap: float = 2.0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    Words are counted once; the sizes (a few bytes per document) are stored in the shared folder and the
    three histograms read only them. The last join is with one row per source and splits if one is hot.
    """
    sizes = stored(sized(docs, doc_id, source, text), "sizes")
    goals = stored(targets(sizes, share, weights, cap), "targets")
    cuts = stored(thresholds(sizes, goals), "cuts").withColumnRenamed("source", "_s")
    joined = sizes.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    # at the last level top is the first hash that is not taken
    copies = F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, *, share: float = 1.5, weights=(5, 2, 1), cap: float = 2.0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them. No join by document: a row's source says all."""
    sizes = stored(sized(docs, doc_id, source, text), "sizes")
    goals = stored(targets(sizes, share, weights, cap), "targets")
    cuts = stored(thresholds(sizes, goals), "cuts").select(F.col("source").alias("_source"), "whole", "cut")
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), id_hash(F.col(doc_id)).alias("h"))
    copies = F.col("whole").cast("int") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    many = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).select("row", copies.alias("copies")).filter("copies > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
