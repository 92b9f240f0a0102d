"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else, in the same document or
another: if the suffix there has the same first WINDOW bytes as another one. Only equality counts, so suffixes
are sorted by a key that is a hash of those bytes, and equal keys are compared byte by byte before anything is removed.

* Difference cover: positions whose place in the document is, modulo 133, in a perfect difference set of 12.
  Any two positions have a distance under 133 after which both are in the cover, so two equal windows share
  an equal cover suffix of 64 bytes within. Cover suffixes are sorted first; windows without a cover suffix
  that may occur twice are never looked at again.
* Blocks and buckets: the remaining windows are sorted one block (range of keys) at a time, and in it one bucket
  at a time. Both counts follow from the bytes there are: a bucket stands for SHARE bytes of text, a block for
  BLOCK bytes a task.
* Ties: windows of equal key are made a tree, in which each piece's first one has a parent in another piece, FAN
  children a parent; a piece sends the text of its windows (runs of windows as one string) to their parents'
  pieces, and there bytes are compared. An edge of equal bytes says that both ends repeat. The ends of any other
  edge are compared once more, grouped by their whole WINDOW bytes: so equal keys of different bytes neither
  remove a byte nor hide a repeat.

Documents are packed once into pieces of about CHUNK bytes in the shared folder. For each bucket a piece
tells its distinct keys (sorted, as differences), so a string that repeats without end inside a piece counts
once. Answers are files per group of pieces, read by the task that holds the pieces: apart from the text of
repeated windows, texts are never shuffled. Keys have as many bits as the number of bytes asks for. All
hashes are prefix sums over the piece, a few vector operations per byte.

Defined cases: a null or empty text has no bytes and keeps none; documents shorter than WINDOW lose nothing;
repeated rows (of equal or null id too) are documents of their own; very long texts span pieces that overlap
and are put together at the end; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import settings, shared_dir, sliced, stored, tasks_for
from quadrat.llm.token_files import put

WINDOW, SEED, CHUNK = 200, 64, 1 << 19
#: Bytes of text that a bucket stands for, and that a block stands for in each task.
SHARE, BLOCK = 6 << 20, 64 << 20
#: Bits of a key beyond those that number all bytes: under one window in 2 ** SPARE meets other bytes under its key.
SPARE = 10
#: Children of a window in the tree of windows with its key (one: a chain, which asks no piece for more than it has); bytes compared at once.
FAN, AT_ONCE = 1, 1 << 21
#: A perfect difference set modulo 133 (every difference occurs once).
PERIOD, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
BASE = 0x9E3779B97F4A7C15  # odd
PIECE_TYPE = "group int, chunk int, docs array<long>, wholes array<string>, bases array<long>, sizes array<long>, data binary"
RESULT_TYPE = "doc_id long, whole string, base long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, data binary, starts array<long>, ends array<long>"


def pack(docs: DataFrame) -> DataFrame:
    """Pieces: documents one after the other; one longer than CHUNK is cut into pieces that overlap by WINDOW - 1."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        group, chunk, cols, size = TaskContext.get().partitionId(), 0, ([], [], [], [], []), 0

        def row():
            ids, wholes, bases, sizes, data = cols
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([chunk], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([wholes], pa.list_(pa.string())), pa.array([bases], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())], [x.split()[0] for x in PIECE_TYPE.split(", ")])

        for b in sliced(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                name = uuid.uuid4().hex if len(raw) > CHUNK else None
                for at in range(0, max(1, len(raw)), CHUNK):
                    part = raw[at : at + CHUNK + (WINDOW - 1)]
                    for c, x in zip(cols, (doc, name, at, len(part), part), strict=True):
                        c.append(x)
                    size += len(part)
                    if size >= CHUNK:
                        yield row()
                        chunk, cols, size = chunk + 1, ([], [], [], [], []), 0
        if cols[0]:
            yield row()

    return stored(docs.mapInArrow(run, PIECE_TYPE), "pieces", "zstd")


class Piece:
    """One piece: where its cover suffixes and windows start, and their keys."""

    powers = None

    def __init__(self, docs, wholes, bases, sizes, data):
        import numpy as np

        self.docs, self.wholes, self.bases, self.sizes, self.data = docs, wholes, np.array(bases, np.int64), np.array(sizes, np.int64), data
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw, self.sums = np.frombuffer(data, np.uint8), None

    def hashes(self):
        import numpy as np

        n = len(self.data)
        if Piece.powers is None or len(Piece.powers[0]) < n:
            up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            Piece.powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        rule = np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)
        rule = (rule ^ (rule >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        rule = (rule ^ (rule >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(rule[self.raw] * Piece.powers[0][:n], out=self.sums[1:])

    def keys(self, at, size: int, bits: int):
        import numpy as np

        if self.sums is None:
            self.hashes()
        h = (self.sums[at + size] - self.sums[at]) * Piece.powers[1][at]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)

    def cover(self):
        """Starts of cover suffixes with SEED bytes of their document after them."""
        import numpy as np

        out = []
        for c in COVER:
            first = self.starts + (c - self.bases) % PERIOD
            count = np.maximum(0, -(-(self.ends - SEED + 1 - first) // PERIOD))
            at = np.repeat(first, count) + PERIOD * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            out.append(at)
        return np.concatenate(out)

    def windows(self, seeds):
        """Starts of windows that hold one of the given cover suffixes; each window of a long document once."""
        import numpy as np

        seeds = np.sort(seeds)
        doc = np.searchsorted(self.starts, seeds, side="right") - 1
        begin = np.maximum(seeds - (WINDOW - SEED), self.starts[doc])
        end = np.minimum(seeds + 1, np.minimum(self.ends - WINDOW + 1, self.starts + CHUNK)[doc])
        some = begin < end
        begin, end = begin[some], end[some]
        if not len(begin):
            return begin
        new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])  # both rise
        begin, end = begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]
        many = end - begin
        return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())


def in_order(x):
    """Distinct values in order (by a plain sort, which is faster here than the library's function)."""
    import numpy as np

    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def distinct_of(keys):
    """Distinct keys in order, the order that sorts the keys, and where each distinct key begins in it."""
    import numpy as np

    order = np.argsort(keys)
    k = keys[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[begin], order, begin


def limits(keys, bits: int, buckets: int, block: int = 0, blocks: int = 1):
    """Of distinct keys in order: where each bucket of a block begins, and the last one's end."""
    import numpy as np

    lo, hi = ((block + i) * (1 << bits) // blocks for i in (0, 1))
    edges = np.array([lo + (hi - lo) * i // buckets for i in range(buckets)] + [hi - 1], np.uint64)
    return np.r_[np.searchsorted(keys, edges[:-1]), np.searchsorted(keys, edges[-1:], side="right")]


class Files:
    """Reads the files of a group of pieces, one group at a time: rows by piece."""

    def __init__(self, root: str):
        from pyarrow import fs as pafs

        (self.fs, self.path), self.at, self.held = pafs.FileSystem.from_uri(root), None, {}

    def of(self, group: int, chunk: int) -> list[dict]:
        import pyarrow as pa

        if self.at != group:
            self.at, self.held = group, {}
            with self.fs.open_input_file(f"{self.path}/group-{group}") as f, pa.ipc.open_stream(f) as batches:
                for b in batches:
                    for row in b.to_pylist():
                        self.held.setdefault(row.pop("chunk"), []).append(row)
        return self.held.pop(chunk, [])


def pieces_of(batches):
    for b in sliced(batches, 1):
        for r in b.to_pylist():
            yield r["group"], r["chunk"], Piece(r["docs"], r["wholes"], r["bases"], r["sizes"], r["data"])


def deliver(rows: DataFrame, groups: list[int], root: str) -> None:
    """Writes the rows (group, chunk and others) of each group of pieces to a file; groups without rows get an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.drop("group").schema)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(root)
        fs.create_dir(path, recursive=True)
        options = pa.ipc.IpcWriteOptions(compression="zstd" if pa.Codec.is_available("zstd") else None)
        at = temp = f = out = None

        def close():
            out.close()
            f.close()
            put(fs, temp, f"{path}/group-{at}")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32())], ["group"])

        for b in sliced(batches):
            names, lo = b.column("group").to_pylist(), 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if at != names[lo]:
                    if at is not None:
                        yield close()
                    at, temp = names[lo], f"{path}/.{uuid.uuid4().hex}"
                    f = fs.open_output_stream(temp)
                    out = pa.ipc.new_stream(f, schema, options=options)
                # rows that only say that the group exists have no piece
                x = b.slice(lo, hi - lo).select(schema.names)
                out.write_batch(pa.RecordBatch.from_arrays(x.filter(x.column("chunk").is_valid()).columns, schema=schema))
                lo = hi
        if at is not None:
            yield close()

    spark = rows.sparkSession
    every = spark.createDataFrame([(g,) for g in groups], "group int")
    rows.unionByName(every, allowMissingColumns=True).repartition(tasks_for(spark), "group").sortWithinPartitions("group").mapInArrow(write, "group int").count()


def settle(told: DataFrame, groups: list[int], firsts: dict[int, int], bits: int, root: str, parents: bool) -> None:
    """Sorts each bucket's keys and tells each piece which of its own other pieces have too; if parents, the piece of each one's parent instead."""

    width = -(-bits // 8)

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        def one(bucket, rows):
            rows.sort(key=lambda r: (r[0], r[1]))
            lists = []
            for r in rows:
                planes = np.zeros((8, len(r[2]) // width), np.uint8)
                planes[:width] = np.frombuffer(r[2], np.uint8).reshape(width, -1)
                lists.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64))
            sizes = [len(x) for x in lists]
            ends = np.cumsum(sizes)
            low, up = min(int(x[0]) for x in lists), max(int(x[-1]) for x in lists)
            tag = (len(rows) - 1).bit_length()
            small = np.uint16 if len(rows) <= 1 << 16 else np.uint32
            if (up - low).bit_length() + tag <= 64:  # the row's number goes into the key's free bits: no indirect sort
                k = np.concatenate([(x - np.uint64(low)) << np.uint64(tag) | np.uint64(i) for i, x in enumerate(lists)])
                lists.clear()
                k.sort()
                row = (k & np.uint64((1 << tag) - 1)).astype(small)
                k >>= np.uint64(tag)
            else:
                row = np.repeat(np.arange(len(rows), dtype=small), sizes)
                k = np.concatenate(lists)
                lists.clear()
                by_key = np.argsort(k, kind="stable")
                k, row = k[by_key], row[by_key]
            again = np.zeros(len(k), bool)  # like the one before it
            again[1:] = k[1:] == k[:-1]
            del k
            back = np.argsort(row, kind="stable")  # each row's keys in their order
            of = []
            if parents:
                place = np.arange(len(again), dtype=np.int64)
                start = np.maximum.accumulate(np.where(again, 0, place))
                numbers = np.array([firsts[r[0]] + r[1] for r in rows], np.uint32)
                above = numbers[row[np.where(again, start + (place - start - 1) // FAN, place)]][back]
                flags = again[back]
                for x, on in zip(np.split(above, ends[:-1]), np.split(flags, ends[:-1]), strict=True):
                    of.append(np.ascontiguousarray(x[on].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
            else:
                again[:-1] |= again[1:]
                flags = again[back]
                of = [None] * len(rows)
            found = [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(found, pa.binary()), pa.array(of, pa.binary())], ["group", "chunk", "bucket", "bits", "parents"])

        at, rows = None, []
        for b in sliced(batches):
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "group", "chunk", "keys")), strict=True):
                if bucket != at and rows:
                    yield one(at, rows)
                    rows = []
                at = bucket
                rows.append(row)
        if rows:
            yield one(at, rows)

    answers = told.repartition(tasks_for(told.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(judge, "group int, chunk int, bucket int, bits binary, parents binary")
    deliver(answers, groups, root)


def tell(pieces: DataFrame, step, bits: int, buckets: int, block: int = 0, blocks: int = 1) -> DataFrame:
    """bucket, group, chunk, keys: a piece's distinct keys in a block, by bucket. step gives a piece's keys."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        find = step()
        for group, chunk, piece in pieces_of(batches):
            keys = in_order(find(group, chunk, piece))
            cuts = limits(keys, bits, buckets, block, blocks)
            names, blobs = [], []
            for bucket, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    diff = np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8")
                    names.append(bucket)
                    blobs.append(np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].T).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([group] * len(names), pa.int32()), pa.array([chunk] * len(names), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "group", "chunk", "keys"])

    return pieces.mapInArrow(run, "bucket int, group int, chunk int, keys binary")


def equal(a, x, b, y):
    """Which of the windows of a from x and of b from y hold the same bytes. Runs of neighbours are compared as one string."""
    import numpy as np

    out = np.empty(len(x), bool)
    if not len(x):
        return out
    first = np.flatnonzero(np.r_[True, (np.diff(x) != 1) | (np.diff(y) != 1)])
    many = np.diff(np.r_[first, len(x)])
    size = many + WINDOW - 1
    upto, lo = np.cumsum(size), 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + AT_ONCE)))
        n, m = size[lo:hi], many[lo:hi]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        bad = np.zeros(len(step) + 1, np.int32)
        np.cumsum(a[np.repeat(x[first[lo:hi]], n) + step] != b[np.repeat(y[first[lo:hi]], n) + step], out=bad[1:])
        at = np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(m.sum())
        out[first[lo] : first[lo] + len(at)] = bad[at + WINDOW] == bad[at]
        lo = hi
    return out


def intervals(at):
    """Positions (any order, with repeats) as maximal intervals."""
    import numpy as np

    at = in_order(at)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1


class Classes:
    """The windows of a piece that may repeat, by key: the first of each key in order of keys, and each one's parent."""

    def __init__(self, piece: Piece, at, bits: int):
        import numpy as np

        self.keys, order, begin = distinct_of(piece.keys(at, WINDOW, bits))
        first = np.minimum.reduceat(order, begin) if len(begin) else begin
        self.first = at[first]
        # the others of each key, and the first one
        many = np.diff(np.r_[begin, len(order)])
        first = np.repeat(first, many)
        self.other = np.sort(order[order != first])
        of = np.empty(len(at), np.int64)
        of[order] = first
        self.like = at[of[self.other]]
        self.other = at[self.other]

    def parents(self, files: list[Files], group: int, chunk: int, bits: int, buckets: int):
        """The number of the piece of each key's parent, or -1."""
        import numpy as np

        out = np.full(len(self.keys), -1, np.int64)
        for block, answers in enumerate(files):
            cuts = limits(self.keys, bits, buckets, block, len(files))
            for row in answers.of(group, chunk):
                a, b = cuts[row["bucket"]], cuts[row["bucket"] + 1]
                on = a + np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a))
                out[on] = np.ascontiguousarray(np.frombuffer(row["parents"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
        return out

    def places(self, keys):
        """Where the first window of each key starts; all keys must be there."""
        import numpy as np

        return self.first[np.searchsorted(self.keys, keys)]


ASKED = "group int, chunk int, sender int, starts array<long>, sizes array<long>, data binary"
#: Windows that repeat, as intervals of where they start; or one that is still to be compared, with its bytes.
SEEN = "group int, chunk int, starts array<long>, ends array<long>, bytes binary"


def asked(piece: Piece, classes: Classes, parents, number: int, place_of):
    """The text of a piece's windows that have a parent, a row for each parent's piece."""
    import numpy as np
    import pyarrow as pa

    on = np.flatnonzero(parents >= 0)
    if not len(on):
        return
    to, at = parents[on], classes.first[on]
    order = np.lexsort((at, to))
    to, at = to[order], at[order]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(to) != 0)])
    last = np.r_[new[1:], len(at)] - 1
    to, begin, end = to[new], at[new], at[last] + WINDOW
    edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    cols = ([], [], [], [], [], [])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        s, e = begin[a:b].tolist(), end[a:b].tolist()
        for c, x in zip(cols, (*place_of(int(to[a])), number, s, [j - i for i, j in zip(s, e, strict=True)], b"".join(piece.data[i:j] for i, j in zip(s, e, strict=True))), strict=True):
            c.append(x)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in ASKED.split(", ")])


def compared(piece: Piece, classes: Classes, group: int, chunk: int, requests: list[dict], place_of, bits: int):
    """SEEN rows of the piece and of those that sent it windows."""
    import numpy as np
    import pyarrow as pa

    seen, doubtful, own = [], [], []

    def told(here, at, data, ok):
        s, e = intervals(at[ok])
        if len(s):
            seen.append((*here, s.tolist(), e.tolist(), None))
        for i in in_order(at[~ok]).tolist():
            doubtful.append((*here, [i], [i + 1], bytes(data[i : i + WINDOW])))

    # the piece's other windows of a key and its first one
    x, y = classes.other, classes.like
    ok = equal(piece.raw, x, piece.raw, y)
    for at in (x, y):
        told((group, chunk), at, piece.data, ok)
    for r in requests:
        sizes = np.array(r["sizes"], np.int64)
        sent = Piece([0] * len(sizes), [None] * len(sizes), [0] * len(sizes), sizes, r["data"])
        many = sizes - WINDOW + 1
        x = np.repeat(sent.starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
        y = classes.places(sent.keys(x, WINDOW, bits))
        ok = equal(sent.raw, x, piece.raw, y)
        # where the windows are in the piece that sent them
        there = x + np.repeat(np.array(r["starts"], np.int64) - sent.starts, many)
        s, e = intervals(there[ok])
        if len(s):
            seen.append((*place_of(r["sender"]), s.tolist(), e.tolist(), None))
        for i in np.flatnonzero(~ok).tolist():
            doubtful.append((*place_of(r["sender"]), [int(there[i])], [int(there[i]) + 1], bytes(r["data"][x[i] : x[i] + WINDOW])))
        own.append((y, ok))
    if own:
        told((group, chunk), np.concatenate([y for y, _ in own]), piece.data, np.concatenate([k for _, k in own]))
    rows = seen + doubtful
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], [x.split()[0] for x in SEEN.split(", ")])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None, bits: int | None = None) -> DataFrame:
    """RESULT_TYPE rows: per document its bytes, removed bytes, maximal removed runs and a hash of what is kept.

    blocks and bits (of a key) follow from the bytes there are unless they are given.
    """
    # a row is a piece, or a bucket's share of one
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.parquet.columnarReaderBatchSize": "16"}):
        return searched(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), blocks, bits)


def searched(docs: DataFrame, blocks: int | None, bits: int | None) -> DataFrame:
    spark = docs.sparkSession
    tasks = tasks_for(spark)
    root = f"{shared_dir(spark)}/quadrat/answers-{uuid.uuid4().hex}"
    pieces = pack(docs)
    # one row per task of pack()
    packed = sorted(map(tuple, pieces.groupBy("group").agg(F.max("chunk"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).collect()))
    groups, firsts, total, n = [], {}, 0, 0
    for group, last_chunk, size in packed:
        groups.append(group)
        firsts[group], n, total = n, n + last_chunk + 1, total + size
    blocks = blocks or max(1, -(-total // (BLOCK * tasks)))
    bits = bits or min(64, total.bit_length() + SPARE)
    buckets = tasks * max(1, -(-total // (SHARE * tasks)))
    per_block = tasks * max(1, -(-total // (SHARE * tasks * blocks)))

    def place_of(number: int) -> tuple[int, int]:
        from bisect import bisect_right

        group = groups[bisect_right(starts_of, number) - 1]
        return group, number - firsts[group]

    starts_of = [firsts[g] for g in groups]

    def seeds():
        return lambda group, chunk, piece: piece.keys(piece.cover(), SEED, bits)

    def chosen():
        """Windows with a cover suffix that may occur twice."""
        import numpy as np

        answers = Files(f"{root}/cover")

        def find(group, chunk, piece):
            at = piece.cover()
            distinct, order, begin = distinct_of(piece.keys(at, SEED, bits))
            count = np.diff(np.r_[begin, len(order)])
            again, cuts = count > 1, limits(distinct, bits, buckets)
            for row in answers.of(group, chunk):
                a, b = cuts[row["bucket"]], cuts[row["bucket"] + 1]
                again[a:b] |= np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a).astype(bool)
            return piece.windows(at[order[np.repeat(again, count)]])

        return find

    def windows():
        find = chosen()
        return lambda group, chunk, piece: piece.keys(find(group, chunk, piece), WINDOW, bits)

    def ask(batches):
        find, files = chosen(), [Files(f"{root}/block-{b}") for b in range(blocks)]
        for group, chunk, piece in pieces_of(batches):
            classes = Classes(piece, find(group, chunk, piece), bits)
            yield from asked(piece, classes, classes.parents(files, group, chunk, bits, per_block), firsts[group] + chunk, place_of)

    def compare(batches):
        find, requests = chosen(), Files(f"{root}/asked")
        for group, chunk, piece in pieces_of(batches):
            classes = Classes(piece, find(group, chunk, piece), bits)
            yield from compared(piece, classes, group, chunk, requests.of(group, chunk), place_of, bits)

    settle(tell(pieces, seeds, bits, buckets), groups, firsts, bits, f"{root}/cover", parents=False)
    for block in range(blocks):
        settle(tell(pieces, windows, bits, per_block, block, blocks), groups, firsts, bits, f"{root}/block-{block}", parents=True)
    deliver(pieces.mapInArrow(ask, ASKED), groups, f"{root}/asked")
    seen = stored(pieces.mapInArrow(compare, SEEN), "seen")
    sure = seen.filter("bytes is null").drop("bytes")
    # ends of edges of different bytes: those of one key meet again only if their whole bytes are equal
    doubtful = seen.filter("bytes is not null").select("bytes", F.struct("group", "chunk", "starts", "ends").alias("at")).distinct()
    if not doubtful.isEmpty():
        often = doubtful.groupBy("bytes").agg(F.count("*").alias("n")).filter("n > 1").select("bytes").hint("merge")
        sure = sure.unionByName(doubtful.join(often, "bytes").select("at.*"))
    deliver(sure, groups, f"{root}/sure")

    def last(batches):
        import numpy as np

        files = Files(f"{root}/sure")
        for group, chunk, piece in pieces_of(batches):
            change = np.zeros(len(piece.data) + 1, np.int64)
            for row in files.of(group, chunk):
                np.add.at(change, row["starts"], 1)
                np.add.at(change, row["ends"], -1)
            yield from results(piece, np.flatnonzero(np.cumsum(change[:-1]) > 0))

    found = stored(pieces.mapInArrow(last, RESULT_TYPE), "repeats")
    if pieces.filter(F.exists("wholes", lambda w: w.isNotNull())).isEmpty():  # every document is in one piece
        return found
    long = found.filter("whole is not null").groupBy("whole").applyInArrow(together, RESULT_TYPE)
    return found.filter("whole is null").unionByName(stored(long, "long-repeats"))


def spans(starts, ends):
    """Maximal runs of [start, end) intervals that are sorted by start and touch or overlap."""
    import numpy as np

    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def digest_of(data: bytes, starts, ends) -> str:
    out, at = hashlib.sha256(), 0
    for a, b in zip(starts, ends, strict=True):
        out.update(data[at:a])
        at = b
    out.update(data[at:])
    return out.hexdigest()


def batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT_TYPE.split(", ")])


def results(piece: Piece, at):
    """One row per document of the piece; of a document that spans pieces, its bytes and runs."""
    import numpy as np

    view, rows, held = memoryview(piece.data), [], 0
    lo, hi = np.searchsorted(at, piece.starts), np.searchsorted(at, piece.ends)
    for i in range(len(piece.docs)):
        raw = view[piece.starts[i] : piece.ends[i]]
        x = at[lo[i] : hi[i]] - piece.starts[i]
        s, e = spans(x, x + WINDOW)
        if piece.wholes[i] is None:
            rows.append((piece.docs[i], None, 0, len(raw), int((e - s).sum()), len(s), digest_of(raw, s.tolist(), e.tolist()), None, None, None))
        else:
            base = int(piece.bases[i])
            rows.append((piece.docs[i], piece.wholes[i], base, None, None, None, None, bytes(raw), (s + base).tolist(), (e + base).tolist()))
            held += len(raw)
        if held > 1 << 25:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def together(table):
    """One document from its pieces."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("base").combine_chunks()
    parts = table.column("data").chunk(0) if table.num_rows else []
    data = b"".join([x.as_buffer()[:CHUNK] for x in parts[:-1]] + [parts[-1].as_buffer()])
    s, e = (table.column(c).chunk(0).flatten().to_numpy() for c in ("starts", "ends"))
    order = np.argsort(s, kind="stable")
    s, e = spans(s[order], e[order])
    first = table.slice(0, 1).to_pylist()[0]
    return pa.Table.from_batches([batch([(first["doc_id"], first["whole"], 0, len(data), int((e - s).sum()), len(s), digest_of(data, s.tolist(), e.tolist()), None, None, None)])])
