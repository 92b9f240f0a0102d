"""Token ids as flat binary files: unsigned integers, 64-bit document offsets, memory-mapped reading.

Documents are range-partitioned and sorted by id; every partition becomes three files in the shared folder:
part-K.bin (ids, little-endian, 2 bytes each if the vocabulary allows, else 4), part-K.off (n + 1 offsets
within the part, int64) and part-K.doc (document ids, int64). Where a part begins in the whole corpus is the
prefix sum of the parts' lengths: only one row per part reaches the driver. A part is written under a
temporary name and renamed, so a task that runs twice leaves one whole file.

A byte-level tokenizer never merges over certain cuts (see CUTS), so each distinct piece between two cuts is
encoded once per worker and remembered (a bounded cache). Cuts are found, and pieces turned into ids, a
whole batch of texts at a time in arrays; other tokenizers, and texts with a special token's name, are encoded
as a whole.

Defined cases: a null or empty text is just the end id; a null document id comes first and stays null;
documents of equal id keep a fixed order by a hash of their text; a very long text is one document, encoded in
pieces like any other; an empty table gives no files and no rows. Only id and text are read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import shared_dir, sliced, small_batches, tasks_for

NO_ID = -(1 << 63)
#: Pieces remembered by a worker (longer ones are not), pieces turned into ids at once, new words encoded as one text.
CACHE, LONGEST, AT_ONCE, WORDS = 600_000, 256, 1 << 20, 2000
#: Bytes of texts that are looked at together.
BYTES = 6 << 20
#: Classes of bytes. FAR: of a character that is not ASCII and surely no white space. UNSURE: control characters
#: on whose class libraries disagree, and characters among which some are white space.
UNSURE, SPACE, LETTER, DIGIT, MARK, QUOTE, FAR = range(7)
#: Between which classes a byte-level tokenizer always cuts: before white space that follows something else, and
#: between letters, digits and marks, but for what may follow an apostrophe.
CUTS = (*((x, SPACE) for x in (LETTER, DIGIT, MARK, QUOTE, FAR)), (LETTER, DIGIT), (LETTER, MARK), (LETTER, QUOTE), (DIGIT, LETTER), (DIGIT, MARK), (DIGIT, QUOTE), (MARK, LETTER), (MARK, DIGIT), (QUOTE, DIGIT))

#: A piece before which the tokenizer cuts whatever stands there: a space, then letters, digits or marks of one kind.
ALONE = re.compile(rb" (?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def classes_of(buf):
    """The class of each byte of UTF-8 texts."""
    import numpy as np

    table = np.full(256, UNSURE, np.uint8)
    table[0x21:0x7F] = MARK
    table[list(b" \t\n\r")] = SPACE
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    table[0x30:0x3A] = DIGIT
    table[0x27] = QUOTE
    out = table[buf]
    at = np.flatnonzero(buf >= 0x80)
    if len(at):
        lead = buf[at] >= 0xC0
        first = buf[at[lead]].astype(np.int32)
        code = first << 8 | buf[np.minimum(at[lead] + 1, len(buf) - 1)]
        # U+00C0 to U+024F but for two signs, and three letters before: two bytes each
        letter = (code >= 0xC380) & (code <= 0xC98F) & (code != 0xC397) & (code != 0xC3B7) | np.isin(code, (0xC2AA, 0xC2B5, 0xC2BA))
        blank = (first == 0xC2) | np.isin(code, (0xE19A, 0xE280, 0xE281, 0xE380))  # some of these are white space
        kind = np.where(letter, LETTER, np.where(blank, UNSURE, FAR)).astype(np.uint8)
        out[at] = kind[np.cumsum(lead) - 1]
    return out


class Encoder:
    def __init__(self, path: str, end_id: int):
        import numpy as np
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.dtype = np.dtype("<u2" if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.array, self.end = np.array, np.array([end_id], self.dtype).tobytes()
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.known, self.older = {}, {}
        self.begins = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")  # how a byte-level vocabulary writes a space
        self.cuts = np.zeros((8, 8), bool)
        self.cuts[tuple(zip(*CUTS, strict=True))] = True
        self.cuts = self.cuts.ravel()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text and the end id, as bytes of self.dtype."""
        import pyarrow as pa

        part = []
        for ids, ends in self.chunks(pa.array(texts, pa.string())):
            at = 0
            for end in ends.tolist():
                yield b"".join([*part, ids[at:end].tobytes()])
                part, at = [], end
            part.append(ids[at:].tobytes())

    def chunks(self, column):
        """Of a string column: ids (the end id after each text) in turn, and where texts end in them."""
        import numpy as np
        import pyarrow as pa

        column = column.cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        lo = 0
        while lo < len(column):  # so many texts at once that they have about BYTES bytes
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BYTES, side="right")) - 1)
            buf = np.frombuffer(data, np.uint8)[off[lo] : off[hi]] if data is not None else np.empty(0, np.uint8)
            yield from self.texts(buf, off[lo : hi + 1] - off[lo])
            lo = hi

    def texts(self, buf, off):
        import numpy as np
        import pyarrow as pa

        starts = self.starts(buf, off)
        # a piece of no length stands for the end of each text
        marks = np.searchsorted(starts, off[1:])
        begin = np.append(np.insert(starts, marks, off[1:]), len(buf))
        is_end = np.zeros(len(begin) - 1, bool)
        is_end[marks + np.arange(len(marks))] = True
        for lo in range(0, len(is_end), AT_ONCE):
            b = begin[lo : lo + AT_ONCE + 1]
            told = pa.Array.from_buffers(pa.large_binary(), len(b) - 1, [None, pa.py_buffer(b - b[0]), pa.py_buffer(buf[b[0] : b[-1]])]).dictionary_encode()
            found = self.ids_of(told.dictionary.to_pylist())
            size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            flat, codes = np.frombuffer(b"".join(found), self.dtype), told.indices.to_numpy()
            kind = np.int32 if max(len(flat), size[codes].sum()) < 1 << 31 else np.int64
            first, n = (np.cumsum(size) - size).astype(kind), size.astype(kind)[codes]
            upto = np.cumsum(n, dtype=kind)
            yield flat[np.repeat(first[codes] - (upto - n), n) + np.arange(upto[-1], dtype=kind)], upto[is_end[lo : lo + AT_ONCE]]

    def starts(self, buf, off):
        """Where pieces start, in order."""
        import numpy as np

        new = np.zeros(len(buf) + 1, bool)
        if self.by_piece and len(buf):
            kind = classes_of(buf)
            kind[1:] |= kind[:-1] << 3
            new[1:-1] = self.cuts[kind[1:] & 63]
            raw = buf.tobytes()
            for name in self.added:  # a text with the name of a special token is one piece
                at = raw.find(name)
                while at >= 0:
                    doc = int(np.searchsorted(off, at, side="right")) - 1
                    new[off[doc] : off[doc + 1]] = False
                    at = raw.find(name, int(off[doc + 1]))
        new[off] = True
        return np.flatnonzero(new[:-1])

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each distinct piece, the end id for an empty one; those of the last CACHE pieces stay at hand."""
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        told = {}
        if older:
            for i in new:
                x = older.get(pieces[i])
                if x is not None:
                    out[i] = told[pieces[i]] = x
            new = [i for i in new if out[i] is None]
        words = [i for i in new if ALONE.fullmatch(pieces[i])]
        ids = self.together([pieces[i] for i in words]) if words else None
        if ids:
            for i, x in zip(words, ids, strict=True):
                out[i] = x
            new = [i for i in new if out[i] is None]
        rest = [i for i in new if pieces[i]]
        for i, x in zip(rest, self.whole([str(pieces[i], "utf-8") for i in rest]), strict=True):
            out[i] = x
        told.update((pieces[i], out[i]) for i in (*(words if ids else ()), *rest) if len(pieces[i]) <= LONGEST)
        known.update(told)
        if len(known) > CACHE:
            self.older, self.known = known, {}
        return [self.end if x is None else x for x in out]

    def together(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of pieces that each are a space and what follows it: WORDS of them as one text, cut where a token begins with the space."""
        parts = [b"".join(words[i : i + WORDS]).decode() for i in range(0, len(words), WORDS)]
        ids = self.array([i for e in self.tok.encode_batch_fast(parts, add_special_tokens=False) for i in e.ids], self.dtype)
        cuts = self.begins[ids].nonzero()[0]
        if len(cuts) != len(words):
            return None
        raw, size = ids.tobytes(), self.dtype.itemsize
        cuts = [*(cuts * size).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> Encoder:
    """One per worker process: later tasks find the pieces that earlier ones have learnt."""
    return Encoder(path, end_id)


def put(fs, temp: str, final: str) -> None:
    """Renames; if another attempt of the task came first, its equal file stays. Without a final file, it failed."""
    from pyarrow import fs as pafs

    try:
        fs.move(temp, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


def encode(docs: DataFrame, tokenizer: str, *, end_id: int = 2, out: str | None = None, doc_id: str = "doc_id", text: str = "text", ordered: bool = True) -> dict:
    """Writes the files and returns the manifest: {"path", "dtype", "parts": [{"part", "docs", "tokens", "base"}]}.

    Without `ordered`, documents stay in the partitions and the order in which docs has them, and nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = out or f"{shared_dir(spark)}/quadrat/tokens-{uuid.uuid4().hex}"
    spark_docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    if ordered:
        spark_docs = spark_docs.repartitionByRange(tasks_for(spark), F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    spark_docs = spark_docs.select("doc_id", "text")

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        encoder, part = encoder_of(tokenizer, end_id), TaskContext.get().partitionId()
        fs, path = pafs.FileSystem.from_uri(out)
        temp, docs_n, tokens = f"{path}/.{part}-{uuid.uuid4().hex}", 0, 0
        bin_f = off_f = doc_f = None
        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            if bin_f is None:
                fs.create_dir(path, recursive=True)
                bin_f, off_f, doc_f = (fs.open_output_stream(f"{temp}.{x}") for x in ("bin", "off", "doc"))
                off_f.write(np.zeros(1, "<i8").tobytes())
            for ids, ends in encoder.chunks(batch.column("text")):
                bin_f.write(ids.tobytes())
                off_f.write((tokens + ends).astype("<i8").tobytes())
                tokens += len(ids)
            doc_f.write(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
            docs_n += batch.num_rows
        if bin_f is not None:
            for x, f in (("bin", bin_f), ("off", off_f), ("doc", doc_f)):
                f.close()
                put(fs, f"{temp}.{x}", f"{path}/part-{part:06d}.{x}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [docs_n], "tokens": [tokens], "dtype": [encoder.dtype.str]})

    rows = sorted(spark_docs.mapInArrow(write, "part int, docs long, tokens long, dtype string").collect())
    parts, base = [], 0
    for r in rows:
        parts.append({"part": r["part"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    return {"path": out, "dtype": rows[0]["dtype"] if rows else "<u2", "parts": parts}


def reader(fs, name: str, kind: str):
    """A file's numbers from a to b: mapped where the system can, else read by range."""
    import numpy as np
    from pyarrow import fs as pafs

    kind = np.dtype(kind)
    if isinstance(fs, pafs.LocalFileSystem):
        mapped = np.memmap(name, kind, "r")
        return lambda a, b: mapped[a:b]
    f = fs.open_input_file(name)
    return lambda a, b: np.frombuffer(f.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)


def parts_of(spark: SparkSession, manifest: dict) -> DataFrame:
    """part, base, docs, tokens of each part, one to a task."""
    rows = [(p["part"], p["base"], p["docs"], p["tokens"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "part int, base long, docs long, tokens long")
    return parts.repartition(len(rows)) if rows else parts


def read(spark: SparkSession, manifest: dict) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: one task per part, mapped, not loaded."""
    root, dtype = manifest["path"], manifest["dtype"]

    def look(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for part, base, docs_n in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "docs")), strict=True):
                stem = f"{path}/part-{part:06d}"
                ids, off, doc = reader(fs, f"{stem}.bin", dtype), reader(fs, f"{stem}.off", "<i8"), reader(fs, f"{stem}.doc", "<i8")
                for at in range(0, docs_n, 1024):
                    to = min(at + 1024, docs_n)
                    d, o = doc(at, to), off(at, to + 1)
                    crc = [zlib.crc32(ids(a, b).astype("<u4")) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.asarray(d), pa.int64(), mask=d == NO_ID), "start": pa.array(o[:-1] + base), "n_tokens": pa.array(np.diff(o)), "ids_crc32": pa.array(crc, pa.int64())})

    return parts_of(spark, manifest).mapInArrow(look, "doc_id long, start long, n_tokens long, ids_crc32 long")
