"""Benchmark decontamination with a hash set of normalised test n-grams.

A benchmark item's windows are its runs of 13 consecutive words (one window if it has fewer). The hashes of all
windows, and of each one's first words, are set bits of one bitmap, sized by their number and of SET bits at
most, which is all that is sent to every task. A document's words are hashed once; at each word the hash
of the next few is looked up, and where its bit is set the hash of the whole window. Only what passes both
leaves the row, to be joined with the benchmark's windows as text: the join verifies
each hit exactly. The benchmark side of that join is broadcast only if the session's size threshold
allows it, else both sides are shuffled by window text; hits are few either way. A benchmark with more windows
than the largest bitmap can tell apart lets more words pass to the join, and loses none.

Defined cases: a null text has no words, no hits and no items; items without words have no windows; equal
items all count; rows of equal (or null) id are each judged, and clean() drops or keeps each for its own text;
an empty benchmark hits nothing; an empty table gives an empty result; a very long text is judged whole in its
row. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import ascii_lower, stored

#: What separates words in a text that still has its upper case.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words of a window that are looked up first: enough to be rare, so that few positions of a corpus pass.
ANCHOR = 4
#: Bits of the bitmap for each hash, and how many it has at least and at most (16 MB).
SPARSE, LEAST, SET = 32, 1 << 16, 1 << 27


def words(text: Column) -> Column:
    # lower case after the split: the separators are the same, and the array is what is needed anyway
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def slot(hashes: Column, at: Column, n: int) -> Column:
    """The hash of the n words from index at (0-based)."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """item, len, window (its words, by one space), slot and whole (hashes of its first words, of all); distinct."""
    w = benchmark.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def window(at: Column) -> Column:
        first = F.coalesce(*[F.when(F.col("len") == k, slot(F.col("h"), at, k)) for k in range(1, ANCHOR)], slot(F.col("h"), at, ANCHOR))
        return F.struct(F.array_join(F.slice("w", at + 1, F.col("len")), " ").alias("window"), first.alias("slot"), whole(F.col("h"), at, F.col("len")).alias("whole"))

    each = w.select("item", "len", F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), window).alias("each"))
    return each.select("item", "len", F.explode_outer("each").alias("x")).select("item", "len", "x.window", "x.slot", "x.whole").distinct()


def whole(hashes: Column, at: Column, n: Column) -> Column:
    """The hash of a whole window."""
    return F.xxhash64(n, F.slice(hashes, at + 1, n))


def hash_set(wins: DataFrame):
    """Whether a hash may be one of the windows': a function of columns over one bitmap, at most SET bits (64 at least)."""
    hashes = wins.select(F.explode(F.array("slot", "whole")).alias("x")).distinct()
    size = max(6, (min(max(LEAST, SPARSE * hashes.count()), SET) - 1).bit_length())
    bit = lambda x: F.shiftrightunsigned(x, 64 - size)
    used = hashes.select(F.shiftright(bit(F.col("x")), 6).alias("id"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x, {64 - size}) & 63 as int))").alias("word"))
    words_of = wins.sparkSession.range(1 << (size - 6)).join(used.groupBy("id").agg(F.bit_or("word").alias("word")), "id", "left")
    in_order = words_of.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("a"))
    bits = stored(in_order.select(F.transform("a", lambda x: x["word"]).alias("bits")), "filter").select("bits").scalar()
    return lambda x: F.getbit(F.get(bits, F.shiftright(bit(x), 6).cast("int")), bit(x).bitwiseAND(63).cast("int")) == 1


def _anchor(k: int):
    return lambda i: F.when(i + k <= F.col("n"), slot(F.col("h"), i, k))


def hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """row (a number of its own), doc_id, n_words and, for each window that occurs, at (word index), len, items; one row of nulls for each document."""
    wins = stored(windows(benchmark, item_id, item_text, n), "windows")
    # one row per window; the lengths that occur (at most n values) shape the plan
    by_window = wins.groupBy("len", "window").agg(F.collect_set("item").alias("items"))
    lens = sorted(r["len"] for r in wins.select("len").distinct().collect())
    w = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    if not lens:
        return w.select("row", "doc_id", F.col("n").cast("long").alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(wins.groupBy().agg(F.collect_set("item")).schema[0].dataType).alias("items"))
    inside = hash_set(wins)
    anchors = sorted({min(k, ANCHOR) for k in lens})
    w = w.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # the hash at each word, for one length after the other, and a null that stands for the document itself
    none = F.array(F.lit(None).cast("long"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    each = [F.transform(places, _anchor(k)) for k in anchors]
    # a step of its own, so that rows that do not pass are never written out with the words; never empty, and outer so
    # that no filter on its size is made of it
    w = w.select("row", "doc_id", "n", "w", "h", F.when(F.col("n") > 0, F.concat(*each, none)).otherwise(none).alias("hashes"))
    w = w.select("row", "doc_id", "n", "w", "h", F.posexplode_outer("hashes").alias("pos", "x"))
    is_doc = F.col("pos") == len(anchors) * F.col("n")
    w = w.filter(is_doc | inside(F.col("x")))
    # windows of which lengths may begin here
    lens_of = F.array(*[F.array(*[F.lit(k) for k in lens if min(k, ANCHOR) == a]) for a in anchors])
    size = F.greatest(F.col("n"), F.lit(1))
    at = (F.col("pos") % size).cast("int")
    may = F.when(is_doc, F.array(F.lit(0))).otherwise(F.get(lens_of, F.floor(F.col("pos") / size).cast("int")))
    w = w.select("row", "doc_id", "n", "w", "h", at.alias("at"), F.explode(may).alias("len"))
    w = w.filter((F.col("len") == 0) | ((F.col("at") + F.col("len") <= F.col("n")) & inside(whole(F.col("h"), F.col("at"), F.col("len")))))
    # a document's own row has a key of its own, which no window has, instead of sharing one
    window = F.when(F.col("len") > 0, F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ")).otherwise(F.xxhash64("row").cast("string"))
    w = w.select("row", "doc_id", F.col("n").cast("long").alias("n_words"), "at", "len", window.alias("window"))
    return w.join(by_window, ["len", "window"], "left").select("row", "doc_id", "n_words", F.when(F.col("items").isNotNull(), F.col("at")).alias("at"), F.when(F.col("items").isNotNull(), F.col("len")).alias("len"), "items")


def judge(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (word intervals, end exclusive), contaminated: hit words are at least 1 / share of all.

    Aggregated by document with partial sums before the shuffle; what is gathered per document is its
    own hits.
    """
    found = hits(docs, benchmark, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, n=n)
    hit = F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("len")).alias("end")))
    by_doc = found.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # intervals by start: words that an interval adds beyond the last end
    init = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grown = F.aggregate("hits", init, lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["at"]), F.lit(0))).alias("n")), lambda s: s["n"])
    out = by_doc.select("doc_id", "n_words", grown.alias("n_hit"), "items", F.col("hits").alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def digest(judged: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    # what a row is judged by: rows of equal id and text are judged alike, those of one id and another text are not
    digest = F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256))
    keyed = docs.select(F.struct(docs[doc_id].alias("id"), digest.alias("digest")).alias("key"), docs[text].alias("text"))
    bad = judge(keyed, benchmark, doc_id="key", text="text", **names).filter("contaminated").select(F.col("doc_id.id").alias("_bad"), F.col("doc_id.digest").alias("_digest")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_bad"]) & (digest == bad["_digest"]), "left_anti")
