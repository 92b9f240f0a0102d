"""Filter audit, Merkle manifest and packing, against the plain way."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import filter_audit, merkle, packing, queries

# filter audit

LABELS = "doc_id long, quality int, toxic int, part string, failed int"
AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PROSE = " ".join(f"w{i}" for i in range(80))
DOCS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE, None), (3, PROSE, ""), (None, PROSE, "a"), (None, "x y", "b"), (4, None, "b"), (5, "", "b"), (6, " \t\n ", "b"), (7, "LOUD " * 60, "b"), (8, PROSE + " 5 %", "c"),
    (9, "word " * 200_000, "c"), (10, "Ünd ÄÖ é " * 30, "c"), (11, "x y", "é"), (12, "x y", "a|b"), (13, PROSE.upper(), "a"), (14, PROSE + " ", "a"), (15, PROSE + "\x0b.", "a"), (16, "#", None), (17, "A" * 5 + "a" * 95, "d"), (18, "A" * 6 + "a" * 94, "d"),
]
LABELLED = [(1, 1, 0), (2, 1, 1), (3, None, 1), (7, 0, None), (7, 0, 1), (None, 1, 1), (9, 1, 0), (99, 1, 1), (4, None, None), (18, 1, 1)]


def audited(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "n", 0.5, 1, True) for d in docs], "doc_id long, text string, source string, same string, spread double, failed int, hot boolean")
    labels = spark.createDataFrame([(*x, "p", 3) for x in labels], LABELS)
    found = filter_audit.audit(filter_audit.judge(docs, labels))
    return {tuple(r[c] for c in AUDIT) for r in found.collect()}


def test_audit_of_odd_rows(spark):
    assert audited(spark, DOCS, LABELLED) == brute.filter_audit(DOCS, LABELLED)


def test_audit_of_many_copies_without_looking_up(spark, monkeypatch):
    docs = [(i, PROSE if i % 3 == 0 else f"{PROSE} {i % 7}", f"s{i % 4}") for i in range(300)] + DOCS
    want = brute.filter_audit(docs, LABELLED)
    assert audited(spark, docs, LABELLED) == want
    monkeypatch.setattr(filter_audit, "HEAVY", 2.0)  # every text is joined by the shuffle
    assert audited(spark, docs, LABELLED) == want


def test_audit_of_more_parts_than_a_task_counts_at_once(spark, monkeypatch):
    import cloudpickle_by_value

    docs = [(i, PROSE if i % 2 else "short", f"s{i % 23}") for i in range(120)]
    monkeypatch.setattr(filter_audit, "PARTS", 5)
    with cloudpickle_by_value.of(filter_audit):
        assert audited(spark, docs, LABELLED) == brute.filter_audit(docs, LABELLED)


def test_audit_of_nothing(spark):
    assert audited(spark, [], LABELLED) == set()
    assert len(audited(spark, [(1, None, None)], [])) == 600


def test_first_failures_are_those_of_the_order():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and not table[0].any()
    k = filter_audit.ORDERS.index("DBACE")
    assert table[0b10001, k] == 3 and table[0b01000, k] == 1 and table[0b10000, k] == 5


# Merkle manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, g string, node string, pos long, n long, block int, path string, tie long"


def merkle_docs(spark, rows):
    return spark.createDataFrame([(*r, "g", "n", 1, 2, 3, "p", 4) for r in rows], FIELDS)


def checked(spark, rows, height, monkeypatch):
    docs = merkle_docs(spark, rows).repartition(3, "doc_id")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    monkeypatch.setattr(merkle.manifest, "__kwdefaults__", merkle.manifest.__kwdefaults__ | {"height": height})
    return sorted(map(tuple, queries.op12_merkle(spark, "").collect()), key=str)


ODD = [
    (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", None, "abd"), (None, None, None, None, None), (None, "", None, 0, ""), (2, "sé", "日本", 10, "日本語 text"), (-7, "s", "de", -1, "x"),
    (3, "s", "", 1, "-"), (4, "s", "zz", 5, "long " * 100_000), (9223372036854775807, "s", "en", 5, "last"),
]


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_merkle_manifest(spark, monkeypatch, height):
    rows = ODD + [(i, f"s{i % 3}", ("en", "de", None)[i % 7 % 3], i, f"text {i}") for i in range(10, 10 + 37)]
    assert checked(spark, rows, height, monkeypatch) == brute.merkle(rows)


def test_merkle_of_few_rows_and_of_lone_leaves(spark, monkeypatch):
    for rows in ([], ODD[:1], ODD[3:4], [ODD[i] for i in (0, 3, 5, 6, 7)], [(i, "s", f"l{i}", i, "t") for i in range(9)]):
        assert checked(spark, rows, 1, monkeypatch) == brute.merkle(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 31, 32, 33])
def test_paths_of_a_block_leaf_by_leaf(size):
    leaves = [merkle.h(str(i)) for i in range(size)]
    for height in (merkle.height_of(size), merkle.height_of(size) + 2):
        levels = [leaves]
        for _ in range(height):
            levels.append([merkle.h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        for leaf, path in enumerate(merkle.traverse(leaves, height)):
            for k, (side, node) in enumerate(path):
                at = leaf >> k ^ 1
                assert node == (levels[k][at] if at < len(levels[k]) else None)
                assert side == (merkle.ALONE if node is None else merkle.BEFORE if leaf >> k & 1 else merkle.AFTER)
        assert merkle.TreeHash(leaves, 0, height).finish() == levels[-1][0]


def test_nodes_at_hand_grow_with_height_only(monkeypatch):
    made, most = [], 0
    class Counted(merkle.TreeHash):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)
    monkeypatch.setattr(merkle, "TreeHash", Counted)
    for _ in merkle.traverse([merkle.h(str(i)) for i in range(1024)], 10):
        made[:] = made[-40:]
        most = max(most, sum(len(t.stack) for t in made if not t.done))
    assert most <= 3 * 10


# packing

NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
WORDS = "The quick brown fox, don't 12 jump é 日本 "


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def packed(spark, rows, width, parts=3):
    docs = spark.createDataFrame([(*r, 1, "o", 2) for r in rows], "doc_id long, text string, offset long, ids string, base long").repartition(parts, F.col("doc_id"))
    m = packing.encode(docs, queries.tokenizer_path())
    return [r.asDict() for r in packing.pieces(spark, m, width=width).collect()], {r.sequence_id: r.ids for r in packing.sequences(spark, m, width=width).collect()}


@pytest.mark.parametrize("width", [2048, 16, 7])
def test_packing_loses_and_repeats_nothing(spark, encoded, width):
    rows = [(i, WORDS * (i % 5)) for i in range(60)] + [(None, "no id"), (100, None), (101, ""), (102, WORDS * 400)]
    found, seqs = packed(spark, rows, width)
    by_doc = {i: encoded(t) for i, t in rows}
    total = sum(map(len, by_doc.values()))
    # pieces of a document follow one another, and are its ids
    for i, ids in by_doc.items():
        mine = sorted((p for p in found if p["doc_id"] == i), key=lambda p: p["start"])
        at = 0
        for p in mine:
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            piece = ids[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            assert seqs[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]] == piece
            at += p["length"]
        assert at == len(ids)
    # sequences have no gaps, are full, and what is left is cut into powers of two
    sizes = []
    for s in sorted(seqs):
        at = 0
        for p in sorted((p for p in found if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == len(seqs[s])
        sizes.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and sum(sizes) == total
    assert all(n == width or n & (n - 1) == 0 for n in sizes) and sizes == sorted(sizes, reverse=True)
    assert sizes.count(width) == total // width


def test_packing_of_repeated_ids_and_of_nothing(spark, encoded):
    found, seqs = packed(spark, [(5, "same"), (5, "same"), (5, "other one")], 4, 2)
    assert sum(p["length"] for p in found) == sum(map(len, seqs.values())) == len(encoded("same")) * 2 + len(encoded("other one"))
    assert packed(spark, [], 8) == ([], {})


def test_packing_of_parts_smaller_than_a_window(spark, encoded):
    rows = [(i, "") for i in range(21)]
    found, seqs = packed(spark, rows, 16, 8)
    assert sorted(map(len, seqs.values())) == [1, 4, 16] and all(set(x) == {1} for x in seqs.values()) and len(found) == 21


def test_packed_documents_of_the_table(spark, tables, encoded):
    want = {r.doc_id: encoded(r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    found = queries.QUERIES["op13_packing"](spark, tables).collect()
    assert set(NAMES) == set(found[0].asDict())
    got = {i: 0 for i in want}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == got[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        got[r.doc_id] += r.length
    assert got == {i: len(x) for i, x in want.items()}
    assert all(r.offset + r.length <= 2048 for r in found)
