"""Packing: all documents' token ids one after the other, cut into sequences of a fixed number of ids.

First pass: every partition encodes its documents where they lie (no text is shuffled) into token files, and tells
its number of ids. The prefix sums of these numbers, one row a partition on the driver, are where each partition begins
in the whole. Second pass: with that, a partition knows where windows of WIDTH ids begin among its own, and cuts. A
window that partitions share is a boundary record of each: pieces() gives its parts as pieces of one sequence,
sequences() puts them together by a group of at most WIDTH ids. All other windows never leave their task.

What is left after the last whole window is cut into powers of two, the largest first, so nothing needs padding.

Defined cases: a null or empty text is just the end id; a null id stays null; rows of one id are documents of their own;
a very long text is cut into many pieces; an empty table gives no rows. Documents stand in the order of the partitions
of docs, so sorted documents give sorted sequences; the same input in the same partitions gives the same result. Only id
and text are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import token_files
from quadrat.llm.token_files import NO_ID, parts_of, reader

WIDTH, END = 2048, 1
#: Ids of a part that a task looks at together.
AT_ONCE = 1 << 20


def encode(docs: DataFrame, tokenizer: str, *, end_id: int = END, doc_id: str = "doc_id", text: str = "text", ordered: bool = False) -> dict:
    """The manifest of the documents' token files, with each part's place in the whole."""
    return token_files.encode(docs, tokenizer, end_id=end_id, doc_id=doc_id, text=text, ordered=ordered)


class Windows:
    """Where sequences begin among `total` ids in a row."""

    def __init__(self, total: int, width: int):
        import numpy as np

        rest = total % width
        self.total, self.width, self.whole = total, width, total - rest
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        self.tail = np.cumsum([self.whole, *powers])[:-1] if powers else np.empty(0, np.int64)

    def between(self, a: int, b: int):
        """Beginnings at a or later and before b."""
        import numpy as np

        full = np.arange(-(-a // self.width) * self.width, min(b, self.whole), self.width)
        return np.concatenate([full, self.tail[(self.tail >= a) & (self.tail < b)]]).astype(np.int64)

    def of(self, at):
        """The sequences that ids are in, and where these begin."""
        import numpy as np

        number = at // self.width
        start = number * self.width
        late = at >= self.whole
        if late.any():
            k = np.searchsorted(self.tail, at[late], side="right") - 1
            number[late], start[late] = self.whole // self.width + k, self.tail[k]
        return number, start

    def size(self, number: int) -> int:
        """How many ids a sequence has."""
        k = int(number) - self.whole // self.width
        return self.width if k < 0 else int((*self.tail[1:], self.total)[k] - self.tail[k])


def windows_of(manifest: dict, width: int) -> Windows:
    return Windows(sum(p["tokens"] for p in manifest["parts"]), width)


def pieces(spark: SparkSession, manifest: dict, *, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of a document in a sequence."""
    root, dtype, windows = manifest["path"], manifest["dtype"], windows_of(manifest, width)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for part, base, docs in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "docs")), strict=True):
                stem = f"{path}/part-{part:06d}"
                ids, off, doc = reader(fs, f"{stem}.bin", dtype), reader(fs, f"{stem}.off", "<i8"), reader(fs, f"{stem}.doc", "<i8")
                for at in range(0, docs, 1024):
                    to = min(at + 1024, docs)
                    d, o = doc(at, to), np.asarray(off(at, to + 1))
                    inside = windows.between(base + int(o[0]), base + int(o[-1])) - base
                    begin = np.union1d(o[:-1], inside)
                    end = np.append(begin[1:], o[-1])
                    of = np.searchsorted(o, begin, side="right") - 1
                    number, first = windows.of(begin + base)
                    crc = np.empty(len(begin), np.int64)
                    lo = 0
                    while lo < len(begin):  # some AT_ONCE ids at a time, a piece at least
                        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + AT_ONCE, side="right")))
                        raw = memoryview(np.asarray(ids(int(begin[lo]), int(end[hi - 1]))).astype("<u4").tobytes())
                        for i in range(lo, hi):
                            crc[i] = zlib.crc32(raw[4 * int(begin[i] - begin[lo]) : 4 * int(end[i] - begin[lo])])
                        lo = hi
                    columns = {"doc_id": pa.array(d[of], pa.int64(), mask=d[of] == NO_ID), "start": begin - o[of], "length": end - begin, "ids_crc32": crc, "doc_tokens": np.diff(o)[of], "sequence_id": number, "offset": begin + base - first}
                    yield pa.RecordBatch.from_pydict(columns)

    return parts_of(spark, manifest).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(spark: SparkSession, manifest: dict, *, width: int = WIDTH) -> DataFrame:
    """sequence_id, ids of every sequence. Only boundary records, of sequences that parts share, are shuffled."""
    root, dtype, windows = manifest["path"], manifest["dtype"], windows_of(manifest, width)

    def records(shared: bool):
        def cut(batches):
            import numpy as np
            import pyarrow as pa
            from pyarrow import fs as pafs

            fs, path = pafs.FileSystem.from_uri(root)
            for batch in batches:
                for part, base, tokens in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "tokens")), strict=True):
                    ids = reader(fs, f"{path}/part-{part:06d}.bin", dtype)
                    begin = np.union1d([base], windows.between(base, base + tokens))
                    end = np.append(begin[1:], base + tokens)
                    number, first = windows.of(begin)
                    whole = (begin == first) & (end - begin == [windows.size(k) for k in number])
                    pick = np.flatnonzero(whole != shared)
                    many = 1 if shared else 64  # whole ones follow one another
                    for k in (pick[i : i + many] for i in range(0, len(pick), many)):
                        x = np.asarray(ids(int(begin[k[0]]) - base, int(end[k[-1]]) - base)).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(np.append(begin[k], end[k[-1]]) - begin[k[0]], pa.int32()), pa.array(x))
                        yield pa.RecordBatch.from_pydict({"sequence_id": number[k], "offset": (begin - first)[k], "ids": lists})

        return parts_of(spark, manifest).mapInArrow(cut, "sequence_id long, offset long, ids array<int>")

    joined = records(True).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return records(False).select("sequence_id", "ids").union(joined.select("sequence_id", F.flatten("x.ids").alias("ids")))
