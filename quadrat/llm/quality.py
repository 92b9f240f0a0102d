"""Quality classifier: cumulative-link (ordinal) regression on graded ratings over hashed words.

Grades: 0 toxic, 1 low quality, 2 good. One weight per hashed feature is shared by all grades, with ordered
thresholds: P(grade >= k) = 1 / (1 + exp(t_k - w x)). x holds a 1 for each distinct feature of a text: its
words, lower-cased, the words' first four and five letters, and marks of its form (runs of symbols, words in
upper case, table bars). A feature counts by how surely its documents' mean grade differs from the overall
mean, so that what tells nothing hardly counts. The model is
fitted on a bounded sample of rated documents (about SAMPLE, by a hash of the id) by full-batch AdaGrad with
an L2 penalty; each document is scored whole. Outputs are the expected grade and the tail probabilities, by
which documents are selected.

Defined cases: a null or empty text has no features and the grade that the thresholds alone give; a rating
with nulls in both columns is none; several ratings of one id: the lowest grade; without ratings every
document has probability 1 and is kept; repeated documents are each scored; rows without an id are scored and judged
like others, but not learnt from; a probability of exactly the least one is kept; a very long text is scored whole, as one
set of features; an empty table gives none. Only id, text and the two ratings are read, so other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import sliced, small_batches

BUCKETS, SAMPLE, GRADES = 1 << 18, 10_000, 3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The forms in which a distinct token is seen more often than in this share of all tokens are features too.
SHARES = (0.02, 0.1, 0.3)


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(toxic.isNotNull() | quality.isNotNull(), 2)


class Features:
    """Slots of the distinct features of a text; a bounded memory of tokens already hashed."""

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh64_intdigest, {}

    def slot(self, token: str) -> int:
        return self.hash(token.encode("utf-8", "surrogatepass")) % BUCKETS

    def of(self, text: str) -> list[int]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        distinct = set(tokens)
        if len(self.known) > 200_000:
            self.known.clear()
        out, known = set(), self.known
        for t in distinct:
            slots = known.get(t)
            if slots is None:
                low = t.lower()
                slots = known[t] = (self.slot(low), *(self.slot(f"{low[:k]}\x01") for k in (4, 5) if len(low) > k and low.isalpha()))
            out.update(slots)
        n = len(tokens)
        counts = {"upper": sum(t.isupper() for t in tokens if len(t) > 1), "symbol": sum(len(t) > 1 and not t[0].isalnum() for t in tokens), "bar": tokens.count("|"), "digit": sum(t[0].isdigit() for t in tokens)}
        out.update(self.slot(f"\x00{kind}>{share}") for kind, c in counts.items() for share in SHARES if c > share * n)
        return sorted(out)


def ratings(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str) -> DataFrame:
    """grade and features of about sample rated documents."""
    small_batches(docs.sparkSession)
    told = labels.select(F.col("doc_id").alias("_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade is not null and _id is not null").groupBy("_id").agg(F.min("grade").alias("grade"))
    n = told.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1
    told = told.filter(F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(1 << 20)) < share)

    def features(batches):
        import pyarrow as pa

        f = Features()
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([f.of(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["grade", "x"])

    return docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(told, "_id").select("grade", "text").mapInArrow(features, "grade int, x array<int>")


def fit(grades, offsets, slots, *, rounds: int = 150, rate: float = 0.3, penalty: float = 1e-3, min_docs: int = 2, sure: float = 5.0, balance: float = 0.0):
    """weights [BUCKETS] and thresholds [GRADES - 1] of the cumulative-link model."""
    import numpy as np

    n = len(grades)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    seen = np.bincount(slots, minlength=BUCKETS)
    keep = (seen >= min_docs)[slots]
    slots, doc = slots[keep], doc[keep]
    used, place = np.flatnonzero(seen >= min_docs), np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    slots = place[slots]
    # how many standard errors the mean grade of a feature's documents is from the overall mean
    often = np.bincount(slots, minlength=len(used))
    off = np.bincount(slots, grades[doc], len(used)) / np.maximum(often, 1) - grades.mean()
    scale = np.minimum(np.abs(off) * np.sqrt(often) / (grades.std() + 1e-9) / sure, 1.0) ** 2
    share = np.bincount(grades, minlength=GRADES) / n
    weight = (share + 1e-9)[grades] ** -balance
    weight /= weight.sum()
    w, t = np.zeros(len(used)), np.log(np.array([(weight[grades < k].sum() + 1e-3) / (weight[grades >= k].sum() + 1e-3) for k in range(1, GRADES)]))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(GRADES - 1))
    gw, gt = np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(rounds):
        eta = np.bincount(doc, (w * scale)[slots], n)
        lower, upper = np.r_[-np.inf, t], np.r_[t, np.inf]
        a, b = sigma(lower[grades] - eta), sigma(upper[grades] - eta)  # P(y < g), P(y <= g)
        p = np.maximum(b - a, 1e-9)
        da, db = weight * a * (1 - a) / p, weight * b * (1 - b) / p
        g = np.bincount(slots, (db - da)[doc], len(used)) * scale + penalty * w  # gradient of -log likelihood by weight
        h = np.array([-db[grades == k].sum() + da[grades == k + 1].sum() for k in range(GRADES - 1)])
        gw, gt = gw + g * g, gt + h * h
        w -= rate * g / np.sqrt(gw)
        t = np.maximum.accumulate(t - rate * h / np.sqrt(gt) + 1e-6 * np.arange(GRADES - 1))
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w * scale
    return out, t


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, **how):
    import numpy as np

    got = ratings(docs, labels, sample, doc_id, text).toArrow().combine_chunks()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks()
    x = x.chunk(0) if hasattr(x, "chunk") else x
    return fit(got.column("grade").to_numpy().astype(int), np.asarray(x.offsets), np.asarray(x.flatten()), **how)


def score(docs: DataFrame, model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_not_toxic (P grade >= 1), p_good (P grade >= 2), expected_grade."""
    kind = docs.schema[doc_id].dataType.simpleString()
    cols = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if model is None:
        return cols.select("doc_id", F.lit(1.0).alias("p_not_toxic"), F.lit(1.0).alias("p_good"), F.lit(2.0).alias("expected_grade"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        (w, t), f = shared.value, Features()
        for b in sliced(batches):
            eta = np.array([float(w[f.of(x)].sum()) for x in b.column("text").to_pylist()])
            tails = 1 / (1 + np.exp(np.clip(t[None, :] - eta[:, None], -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails.sum(1))], ["doc_id", "p_not_toxic", "p_good", "expected_grade"])

    return cols.mapInArrow(run, f"doc_id {kind}, p_not_toxic double, p_good double, expected_grade double")


def judge(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds keep: more likely good than not."""
    return scored.withColumn("keep", F.col("p_good") >= least)


def select(docs: DataFrame, model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that judge() would keep; one pass, no join."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        (w, t), f = shared.value, Features()
        for b in sliced(batches):
            eta = np.array([float(w[f.of(x or "")].sum()) for x in b.column(text).to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(np.clip(t[1] - eta, -40, 40))) >= least))

    return docs.mapInArrow(run, docs.schema)
