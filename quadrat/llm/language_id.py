"""Language identification: multinomial naive Bayes over hashed character n-grams.

Grams are runs of 1 to 3 characters (code points, A-Z lower-cased), hashed into a table of fixed size. The
counts come from a bounded sample of the labelled training documents (about SAMPLE of them, dealt evenly to the
languages so that rare ones are learnt too, chosen by a hash of the id); the priors are counts of all labelled
training documents, a row for each language. Every document is scored whole, in blocks: look up each gram's row of log
probabilities and sum by document. The model is buckets x languages numbers, broadcast; that and the counts are
as many as there are languages, which a label column has few of.

Defined cases: a null text, or one without letters, is "und" with score 0; with no labelled training
document, or none with a character in it, all are "und"; a null id is not held out and not learnt from; ties go to the
first language by code point; repeated rows each count; a very long text is scored whole, a block at a time; an empty
table gives an empty result. Only id, text and label are read, so other columns may have any name; a
prediction uses the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import sliced, small_batches

BUCKETS, GRAMS, SAMPLE, BLOCK = 1 << 16, (1, 2, 3), 20_000, 1 << 19
#: Odd multipliers of the characters of a gram.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def gram_blocks(buf, starts, ends):
    """Blocks of (bucket of each gram, first index of each document in the block, number of the document)."""
    import numpy as np

    for n in GRAMS:
        live = np.flatnonzero(ends - starts >= n)
        for lo in range(0, len(buf) - n + 1, BLOCK):
            hi = min(lo + BLOCK, len(buf) - n + 1)
            a, b = np.searchsorted(ends[live] - n, lo), np.searchsorted(starts[live], hi)
            docs = live[a:b]
            if not len(docs):
                continue
            code = np.full(hi - lo, n, np.uint32)
            for k in range(n):
                code += (buf[lo + k : hi + k] + np.uint32(1)) * np.uint32(MIX[k])
            code ^= code >> np.uint32(15)
            slot = (code * np.uint32(2654435761)) >> np.uint32(16)
            first, last = np.maximum(starts[docs], lo) - lo, np.minimum(ends[docs] - n + 1, hi) - lo
            yield slot, first, last, docs


def buffers(column):
    """The lower-cased code points of a string column and where each text starts and ends."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = (data.to_pybytes() if data is not None else b"")[off[0] : off[-1]].lower()
    before = np.zeros(len(raw) + 1, np.int64)  # characters that begin before each byte
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=before[1:])
    off = before[off - off[0]]
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), off[:-1], off[1:]


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], object, object] | None:
    """The languages, the log probabilities [BUCKETS, languages] and the log priors."""
    import numpy as np

    small_batches(docs.sparkSession)
    label = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    held = label.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("n")).collect()
    if not held:
        return None
    limits = [(r["_lang"], int(min(1.0, sample / len(held) / r["n"]) * (1 << 20)) + 1) for r in held]
    few = len(limits) <= 4096  # languages: else the session's threshold decides
    limits = docs.sparkSession.createDataFrame(limits, "_lang string, _limit long")
    limits = F.broadcast(limits) if few else limits
    chosen = label.join(limits, F.col(lang) == F.col("_lang")).filter(F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 20)) < F.col("_limit"))

    def count(batches):
        import pyarrow as pa

        sums = {}
        for batch in sliced(batches, 1024):
            names = np.array(batch.column("lang").to_pylist(), object)
            buf, starts, ends = buffers(batch.column("text"))
            for slot, first, last, which in gram_blocks(buf, starts, ends):
                for name in set(names[which]):
                    one = np.zeros(len(slot) + 1, np.int32)
                    mine = names[which] == name
                    np.add.at(one, first[mine], 1)
                    np.add.at(one, last[mine], -1)
                    sums[name] = sums.get(name, 0) + np.bincount(slot[np.cumsum(one[:-1]) > 0], minlength=BUCKETS)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "slot": pa.array(at.astype(np.int32)), "n": pa.array(c[at].astype(np.int64))})

    got = chosen.select(F.col("_lang").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    names = sorted(r["_lang"] for r in held)
    table = np.full((BUCKETS, len(names)), 0.5)
    where = {x: i for i, x in enumerate(names)}
    np.add.at(table, (got.column("slot").to_numpy(), np.array([where[x] for x in got.column("lang").to_pylist()], int)), got.column("n").to_numpy())
    seen = np.array([dict(held)[x] for x in names], float) + 1
    return names, np.log(table / table.sum(0)).astype(np.float32), np.log(seen / seen.sum())


def predict(docs: DataFrame, model: tuple[list[str], object, object] | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior probability)."""
    spark = docs.sparkSession
    small_batches(spark)
    t = F.col(text)
    cols = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(t, F.lit("")).alias("text"), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return cols.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        names, table, prior = shared.value
        for batch in sliced(batches, 1024):
            buf, starts, ends = buffers(batch.column("text"))
            total = np.tile(prior, (batch.num_rows, 1))
            for slot, first, last, which in gram_blocks(buf, starts, ends):
                rows = table[slot]
                # grams that cross into the next document lie between last and the next first
                edges = np.empty(2 * len(first), np.int64)
                edges[0::2], edges[1::2] = first, last
                sums = np.add.reduceat(np.vstack([rows, np.zeros((1, len(names)), rows.dtype)]), np.minimum(edges, len(rows)), axis=0, dtype=np.float64)[0::2]
                total[which] += sums
            total -= total.max(1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(1, keepdims=True)
            best, letters = p.argmax(1), batch.column("letters").to_numpy(zero_copy_only=False)
            pred = np.where(letters, np.array(names, object)[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(letters, p.max(1), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return cols.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
