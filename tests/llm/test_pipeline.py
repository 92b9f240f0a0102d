import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import decontamination, ngram_join


@pytest.fixture(scope="module")
def steps(spark, tables, tmp_path_factory):
    """What each stage makes of the Parquet of the stage before."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], tables).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_return_documents_until_the_last(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(d.columns == steps[0].columns and d.dtypes == steps[0].dtypes for d in steps[:-1])


def test_good_documents_stay_and_toxic_ones_go(spark, tables, steps):
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    assert np.mean([r.doc_id in kept for r in labels if r.quality == 1 and r.toxic == 0]) > 0.97
    assert np.mean([r.doc_id in kept for r in labels if r.toxic == 1]) < 0.35


def test_one_of_each_group_stays(steps):
    rows = [tuple(r) for r in steps[1].select("doc_id", "text").collect()]
    want = {d for d, (_, c) in brute.jaccard(rows, 5, 80).items() if c == d}
    assert {r.doc_id for r in steps[2].select("doc_id").collect()} == want


def test_contaminated_documents_go(spark, tables, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in steps[2].select("doc_id", "text").collect()]
    want = {r[0] for r in brute.decontamination(rows, items) if not r[5]}
    assert {r.doc_id for r in steps[3].select("doc_id").collect()} == want


def test_mix_repeats_rows_towards_the_budget(steps):
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(steps[4]) - 1.5 * words(steps[3])) < 0.1 * words(steps[3])
    assert steps[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_tokens_hold_every_document_of_the_mix(steps):
    assert steps[5].count() == steps[4].count()
    got = steps[5].orderBy("start").collect()
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def test_run_is_all_stages(spark, tables, steps):
    cols = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, tables).select(cols).exceptAll(steps[5].select(cols)).isEmpty()


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_decide_rows_of_null_and_repeated_ids_by_their_own_texts(spark):
    passage, other, third = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqr")
    cols = "doc_id long, text string, digest string, n long"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(None, passage, "a", 1), (None, other, "b", 2), (1, passage, "c", 3), (1, third, "d", 4), (2, passage, "e", 5), (3, None, "f", 6), (None, None, "g", 7), (4, other, "h", 8), (4, other, "i", 9)]
    clean = decontamination.clean(spark.createDataFrame(rows, cols), bench)
    assert clean.columns == ["doc_id", "text", "digest", "n"]
    assert kept(clean) == sorted([r for r in rows if r[1] != passage], key=str)

    near = other.replace("q19", "q19 more")
    rows = [(7, passage, "a", 1), (7, passage, "a", 1), (None, other, "b", 2), (None, near, "c", 3), (5, third, "d", 4), (6, third, "e", 5), (6, " ".join("uvwxyz"), "f", 6), (None, third, "g", 7), (8, None, "h", 8), (8, None, "i", 9)]
    for part, want in ((rows, [rows[i] for i in (0, 2, 3, 4, 6, 7, 8, 9)]), (rows[4:6], rows[4:5]), (rows[5:6] * 2 + rows[4:5] + rows[7:8], [rows[4], rows[7]])):
        one = ngram_join.keep_one(spark.createDataFrame(part, cols).coalesce(1))
        assert one.columns == ["doc_id", "text", "digest", "n"]
        assert kept(one) == sorted(want, key=str)


def folder(spark, path, docs, labels=(), benchmark=()):
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long, row string, size string, digest string, h string, copies string, part string"),
        "labels": (list(labels), "doc_id long, quality int, toxic int"), "benchmark": (list(benchmark), "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_run_on_odd_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    from quadrat.llm.queries import tokenizer_path

    passage = " ".join(f"p{i}" for i in range(20))
    copied, long = " ".join(f"c{i}" for i in range(30)), " ".join(f"v{i}" for i in range(150_000))
    texts = [(1, copied), (2, copied), (2, copied + " end"), (3, passage), (None, passage), (None, copied), (4, None), (4, ""), (5, long), (6, long + " more"), (7, long + " " + passage), (8, "日本 語 \U0001f389"), (None, None)]
    extra = ("r", "s", "d", "h", "c", "p")
    docs = [(i, t, None, "web", None, *extra) for i, t in texts]
    path = folder(spark, tmp_path / "odd", docs, [(1, None, None), (None, 1, 0)], [(1, passage), (2, None), (None, "")])
    got = corpus_pipeline.run(spark, path).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    # copies and contaminated rows go; 7 holds the passage, but in under 5 % of its words, and is near to 5
    want = {(None, copied), (None, None), (1, copied), (4, None), (4, ""), (5, long), (8, texts[11][1])}
    encode = Tokenizer.from_file(tokenizer_path()).encode
    sizes = {(i, len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want}
    assert {(r.doc_id, r.n_tokens) for r in got} == sizes
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [])).isEmpty()
    one = folder(spark, tmp_path / "one", [(1, "a few words", None, None, None, *"rsdhcp")])
    assert {r.doc_id for r in corpus_pipeline.run(spark, one).collect()} == {1}
