import random
import zlib

import brute
import numpy as np
import pytest

from quadrat.llm import components, language_id, ngram_join, quality, suffix_dedup, token_files, topk
from quadrat.llm.queries import QUERIES, tokenizer_path

EXTRA = ", n long, hub long, label string, digest string, counts string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "l", "d", "c") for r in rows], "doc_id long, text string" + EXTRA)


def texts(spark, tables):
    return [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]


# token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, rows):
    out, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ODD = [None, "", " ", "  a  b \n\n c\t", "don't 12 3² ½x y'll Ünï çà", "x\x1cy \x1f z!\x1c", "日本語 “quoted” – dash", "a\u00a0b\u2003c", "<|endoftext|> end", "$$$ %%% !!a 'sa ''s", "e\u0301 \u0301e", "word " * 70000, "tab\x85next", "🎉🎉 é_1a1", "I'M we'RE\r\n"]


def test_token_files_equal_the_tokenizer(spark, tokenizer):
    rows = list(enumerate(ODD))
    got = token_files.read(spark, token_files.encode(docs_of(spark, rows[::-1]), tokenizer_path()))
    assert sorted(map(tuple, got.collect())) == expected(tokenizer, rows)


def test_token_files_of_random_texts(spark, tokenizer):
    rng = random.Random(0)
    rows = [(i, "".join(rng.choice(" \n\tab.,'s1²éßλ日\x1c$<|") for _ in range(rng.randint(0, 80)))) for i in range(400)]
    got = token_files.read(spark, token_files.encode(docs_of(spark, rows), tokenizer_path()))
    assert sorted(map(tuple, got.collect())) == expected(tokenizer, rows)


def test_token_files_round_trip_and_cases(spark, tokenizer):
    m = token_files.encode(docs_of(spark, [(5, "five"), (None, "none"), (5, "five"), (1, "one two")]), tokenizer_path())
    got = sorted(token_files.read(spark, m).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 5, 5] and m["dtype"] == "<u2"
    ids = np.concatenate([np.fromfile(f"{m['path'][7:]}/part-{p['part']:06d}.bin", m["dtype"]) for p in m["parts"]])
    assert tokenizer.decode([x for x in ids.tolist() if x != 2]) == "noneone twofivefive"
    empty = token_files.encode(docs_of(spark, []), tokenizer_path())
    assert empty["parts"] == [] and token_files.read(spark, empty).count() == 0


def test_encoder_forgets_within_its_bound(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 40)
    e = token_files.Encoder(tokenizer_path(), 2)
    many = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    assert [np.frombuffer(b, e.dtype).tolist()[:-1] for t in many for b in e.encode([t])] == [tokenizer.encode(t).ids for t in many]
    assert len(e.known) <= 80


# suffix dedup

COLS5 = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeats(spark, rows, **how):
    return suffix_dedup.repeats(docs_of(spark, rows), **how)


def test_suffix_dedup_on_documents(spark, tables):
    rows = texts(spark, tables)
    got = {r.doc_id: tuple(r[c] for c in COLS5) for r in QUERIES["op5_suffix_dedup"](spark, tables).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.repeats([t for _, t in rows]), strict=True)}


def test_suffix_dedup_cases(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b, c = noise(200), noise(199), noise(450)
    rows = [None, "", a, noise(77) + a, b, b + "x", a + a, "z" * 500, "z" * 200, noise(50) + c[:250] + noise(9), c[200:], c, "é" * 150, noise(300), noise(31) + c[100:310], a[1:] + "q", "q" + a[:199]]
    got = {r.doc_id: tuple(r[k] for k in COLS5) for r in repeats(spark, list(enumerate(rows))).collect()}
    assert got == dict(enumerate(brute.repeats(rows)))
    same = [(7, a), (7, a), (None, a), (None, "short")]
    assert sorted((r.n_bytes, r.n_removed) for r in repeats(spark, same).collect()) == [(5, 0), (200, 200), (200, 200), (200, 200)]
    assert repeats(spark, []).count() == 0


def test_suffix_dedup_of_texts_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    p, long = noise(400), noise(5000)
    rows = [long[:1000] + p + long[1000:], noise(650) + p + noise(3), p[:260], long[2300:3100], "ab" * 900, noise(699), noise(700), noise(701)]
    import cloudpickle_by_value  # workers know the patched module only if it is sent by value

    with cloudpickle_by_value.of(suffix_dedup):
        got = {r.doc_id: tuple(r[k] for k in COLS5) for r in repeats(spark, list(enumerate(rows)), blocks=2).collect()}
    assert got == dict(enumerate(brute.repeats(rows)))


@pytest.mark.parametrize("fan", [1, 32])
def test_suffix_dedup_compares_bytes_where_keys_are_equal(spark, monkeypatch, fan):
    """Keys of 8 bits: nearly every window has the key of windows with other bytes, in its piece and in others."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b = noise(260), noise(420)
    rows = [noise(700), a + noise(90), noise(640), b, noise(30) + a, noise(200), "q" + b[100:], noise(200), noise(333) + a[:230], "xy" * 200, noise(500) + "xy" * 110, noise(800)]
    import cloudpickle_by_value

    with cloudpickle_by_value.of(suffix_dedup):
        got = {r.doc_id: tuple(r[k] for k in COLS5) for r in repeats(spark, list(enumerate(rows)), bits=8).collect()}
    assert got == dict(enumerate(brute.repeats(rows)))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from quadrat.llm.common import shared_dir

    session = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    assert shared_dir(session("local[4]")) and shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("spark://host:7077"))


def test_suffix_dedup_leaves_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    repeats(spark, [(1, "a" * 500)]).collect()
    assert spark.conf.get(key) == before


def test_cover_meets_every_distance():
    d = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert len(d) == suffix_dedup.PERIOD and suffix_dedup.WINDOW - suffix_dedup.PERIOD + 1 >= suffix_dedup.SEED


# language


def test_language_held_out_accuracy_and_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, tables).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == brute.held_out(r.doc_id) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held = [r for r in rows if brute.held_out(r.doc_id)]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_language_cases(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der Hund und die Katze " * 3, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "123 !!", "de"), (102, "", None), (None, "the dog", "en"), (103, "the und and" * 90000, None), (1, "the dog and", "en")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model[0] == ["de", "en"]
    got = {}
    for r in language_id.predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(got[i][0].lang_pred, got[i][0].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(got[i][0].lang_pred == lang for i, _, lang in rows) and got[None][0].lang_pred == "en" and not got[None][0].held_out and len(got[1]) == 2
    none = docs.withColumn("lang", docs.lang.substr(9, 1)).filter("false")
    assert language_id.train(none) is None and language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_language_equals_plain_naive_bayes(spark, tables):
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "日本語のテキスト", "ja"), (-2, "これは日本語", "ja"), (-3, "日本", None), (-4, "Ünï", None), (-5, "x", None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = docs.collect()

    def grams(text):
        x = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text or ""]
        for n in language_id.GRAMS:
            for i in range(len(x) - n + 1):
                code = (n + sum((c + 1) * m for c, m in zip(x[i : i + n], language_id.MIX, strict=False))) & 0xFFFFFFFF
                yield ((code ^ code >> 15) * 2654435761 & 0xFFFFFFFF) >> 16

    counts, n = {}, Counter()
    for r in rows:
        if r.lang is not None and not brute.held_out(r.doc_id):
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            n[r.lang] += 1
    names = sorted(counts)
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        slots = Counter(grams(r.text))
        of = {x: math.log((n[x] + 1) / (sum(n.values()) + len(n))) + sum(k * math.log((counts[x][s] + 0.5) / (sum(counts[x].values()) + 0.5 * language_id.BUCKETS)) for s, k in slots.items()) for x in names}
        best = max(names, key=of.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(of[x] - of[best]) for x in names)) < 1e-3


def test_language_without_a_character_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "", "en") for i in range(9)] + [(20, "some words", None)], "doc_id long, text string, lang string")
    assert language_id.train(docs) is None
    one = docs.union(spark.createDataFrame([(30, "a", "de"), (31, "b", "de")], docs.schema))
    assert {r.lang_pred for r in language_id.predict(one, language_id.train(one)).collect()} <= {"und", "en", "de"}


def test_language_scores_equal_a_plain_sum():
    import pyarrow as pa

    some = ["Ab cé", "", "x", "日本", "longer text here"]
    buf, starts, ends = language_id.buffers(pa.array(some))
    seen = {}
    for slot, first, last, which in language_id.gram_blocks(buf, starts, ends):
        for d, a, b in zip(which, first, last, strict=True):
            seen[d] = seen.get(d, 0) + b - a
    assert seen == {i: sum(max(0, len(t) - n + 1) for n in language_id.GRAMS) for i, t in enumerate(some) if t}  # characters, not bytes


# n-gram join


def joined(spark, rows, k, num):
    from fractions import Fraction

    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, rows), k=k, similarity=Fraction(num, 100)).collect()}


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_join_on_documents(spark, tables, k, num):
    rows = texts(spark, tables)
    assert joined(spark, rows, k, num) == brute.jaccard(rows, k, num)


@pytest.mark.parametrize("seed", [0, 1])
def test_join_of_groups_of_edited_copies(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
            rows.append((len(rows) * 3 + 1, " ".join(w[rng.randint(0, 2) :])))
    assert joined(spark, rows, 3, 90) == brute.jaccard(rows, 3, 90)
    assert joined(spark, rows, 2, 70) == brute.jaccard(rows, 2, 70)


def test_join_tells_few_pairs_of_copies_a_little_too_far_apart(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 300)}" for _ in range(400)]
    rows = [(len(base) + i, " ".join(f"e{rng.randint(0, 9999)}" if j in edits else w for j, w in enumerate(base))) for i in range(60) for edits in [set(rng.sample(range(400), 8))]]
    told, of = [], type(docs_of(spark, []))
    run = of.mapInArrow

    def counted(self, f, schema, *more, **how):
        out = run(self, f, schema, *more, **how)
        if "small long" in str(schema):
            told.append(out.count())
        return out

    monkeypatch.setattr(of, "mapInArrow", counted)
    assert joined(spark, rows, 5, 80) == brute.jaccard(rows, 5, 80)
    assert len(told) == 1 and told[0] <= 60  # of 1,770 pairs, each of which a task may tell


def test_parities_differ_no_more_than_the_sets():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = []
    for n in (0, 1, 7, 300, 2048, 2049, 5000, 40000):
        s = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        sets += [s, np.unique(np.r_[s[n // 50 :], rng.integers(0, 1 << 64, n // 40 + 3, np.uint64)])]
    of = ngram_join.Parities(pa.array([ngram_join.parities(s) for s in sets], pa.binary()))
    assert of.length.min() == ngram_join.BITS // 8 and of.length.max() == ngram_join.MOST_BITS // 8
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = of.differ(i, of, j)
    for a, b, d in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        apart = len(np.setxor1d(sets[a], sets[b], assume_unique=True))
        assert d <= apart and (apart - d) % 2 == 0 and (apart > 300 or d >= apart * 0.7)


def test_join_at_low_similarity_keeps_links_of_short_texts(spark):
    rows = [(1, "a b c"), (2, "a b c d"), (3, "q r"), (4, "x y z"), (5, "w x y z"), (6, "x y z w v"), (7, "q")]
    assert joined(spark, rows, 3, 50) == brute.jaccard(rows, 3, 50)
    assert joined(spark, rows, 3, 50)[2][1] == 1


def test_join_deals_hot_ngrams_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(3)
    rows = []
    for g in range(3):  # near copies of one text, beside texts that share a passage only
        base = [f"g{g}w{i}" for i in range(40)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(40)] = f"e{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
        rows += [(len(rows) + i, " ".join(base[: rng.randint(4, 30)])) for i in range(20)]
    assert joined(spark, rows, 3, 90) == brute.jaccard(rows, 3, 90)
    assert joined(spark, rows, 2, 60) == brute.jaccard(rows, 2, 60)


def test_join_compares_words_where_hashes_collide(spark, monkeypatch):
    import cloudpickle_by_value

    rows = [(1, "alpha beta gamma"), (2, "delta epsilon zeta"), (3, "Alpha  beta gamma"), (4, "a a a a"), (5, "a a a"), (7, "two words"), (8, "words two"), (9, "one")]
    monkeypatch.setattr(ngram_join, "hashed", lambda words, k: np.zeros(max(len(words) - k + 1, 1) if words else 0, np.uint64))
    with cloudpickle_by_value.of(ngram_join):
        found = joined(spark, rows, 3, 90)
    assert found == brute.jaccard(rows, 3, 90)
    assert found[2] == (1, 2) and found[3] == (1, 1) and found[5] == (1, 4)


def test_overlap_is_that_of_words():
    rng = random.Random(5)
    for k in (1, 2, 3, 5, 12):
        for _ in range(60):
            a, b = ([rng.choice([b"a", b"b", b"c", b"long", *(b"w%d" % i for i in range(rng.choice([0, 900])))]) for _ in range(rng.randint(1, 60))] for _ in "ab")
            if rng.random() < 0.5:
                b = a[: rng.randint(1, len(a))] + b[:3]
            sets = [set(zip(*(x[j:] for j in range(k)), strict=False)) if len(x) >= k else {tuple(x)} for x in (a, b)]
            got = ngram_join.overlap(a, b, k)
            assert got[2] == len(sets[0] & sets[1]) and (min(len(a), len(b)) < k or got[:2] == (len(sets[0]), len(sets[1])))


def test_join_cases(spark):
    long = " ".join(f"v{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tB"), (8, "a b c d"), (9, long), (10, long + " end"), (11, "x\u00a0y z w"), (12, "x y z w")]
    got = joined(spark, rows, 3, 90)
    assert got == brute.jaccard(rows, 3, 90)
    assert got[5] == (1, 4) and got[7] == (1, 6) and got[10][1] == 9 and got[2] == (0, 2)
    more = ngram_join.join(docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in more) == [("1", "1"), ("1", "1"), ("2", "2"), ("None", "None")]
    assert ngram_join.join(docs_of(spark, [])).count() == 0
    kept = ngram_join.keep_one(docs_of(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]))
    assert kept.columns == docs_of(spark, []).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# quality


def test_quality_rejects_toxic_and_keeps_good(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op8_quality"](spark, tables).collect()}
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    good = [got[r.doc_id].keep for r in labels if r.quality == 1 and r.toxic == 0 and r.doc_id in got]
    toxic = [got[r.doc_id].keep for r in labels if r.toxic == 1 and r.doc_id in got]
    assert np.mean(good) > 0.97 and np.mean(toxic) < 0.35
    assert all(0 <= r.p_good <= r.p_not_toxic <= 1 and np.isclose(r.expected_grade, r.p_good + r.p_not_toxic) for r in got.values())


def test_quality_held_out(spark, tables):
    """Trained on half of the rated documents, most of the other half's grades are told apart."""
    docs, labels = (spark.read.parquet(f"{tables}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r.keep for r in quality.judge(quality.score(docs, model)).collect()}
    rest = labels.filter("doc_id % 2 = 1").collect()
    good, bad = ([got[r.doc_id] for r in rest if (r.quality == 1 and r.toxic == 0) == want] for want in (True, False))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4


def test_quality_cases(spark):
    rows = [(i, f"fine words here {i}" if i % 3 else f"horrid words here {i}") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(1, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (200, None), (201, ""), (None, "horrid"), (202, "fine words " * 50000)])
    model = quality.train(docs, labels)
    got = {r.doc_id: r.keep for r in quality.judge(quality.score(docs, model)).collect()}
    assert all(got[i] == bool(i % 3) for i, _ in rows) and not got[None] and got[202] and got[200] == got[201]
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.train(docs, labels.filter("false")) is None and quality.score(docs.filter("false"), model).count() == 0
    assert all(r.keep for r in quality.judge(quality.score(docs, None)).collect())


def test_quality_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    slots = rng.integers(0, 50, (300, 5))
    weight = rng.normal(size=50)
    eta = weight[slots].sum(1)
    grades = np.digitize(eta + rng.logistic(size=300), [-1.5, 1.0])
    w, t = quality.fit(grades, np.arange(0, 1501, 5), slots.ravel(), penalty=1e-3)
    assert t[0] < t[1] and np.corrcoef(w[slots].sum(1), eta)[0, 1] > 0.8


# top-k


def test_quality_scores_equal_a_plain_sum(spark, tables):
    import math

    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (None, "fine words here"), (-3, "word " * 30000 + "| | |"), (-4, "$$$ %%% AAA")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    w, t = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    got = {r.doc_id: r for r in quality.score(docs, (w, t)).collect()}
    f = quality.Features()
    for r in docs.collect():
        tokens = __import__("re").findall(r"\w+|[^\w\s]+", r.text or "")
        names = set()
        for x in tokens:
            low = x.lower()
            names |= {low} | {low[:k] + "\x01" for k in (4, 5) if len(low) > k and low.isalpha()}
        forms = {"upper": [x for x in tokens if len(x) > 1 and x.isupper()], "symbol": [x for x in tokens if len(x) > 1 and not x[0].isalnum()], "bar": [x for x in tokens if x == "|"], "digit": [x for x in tokens if x[0].isdigit()]}
        names |= {f"\x00{kind}>{share}" for kind, x in forms.items() for share in quality.SHARES if tokens and len(x) > share * len(tokens)}
        eta = sum(float(w[s]) for s in {f.slot(x) for x in names})
        tails = [1 / (1 + math.exp(x - eta)) for x in t]
        assert abs(got[r.doc_id].p_not_toxic - tails[0]) < 1e-4 and abs(got[r.doc_id].p_good - tails[1]) < 1e-4
        assert abs(got[r.doc_id].expected_grade - sum(tails)) < 2e-4


def test_quality_fit_reaches_the_optimum_of_its_likelihood():
    """Against plain gradient descent with numeric gradients on the penalised likelihood, written out."""
    rng = np.random.default_rng(2)
    n, m = 400, 5
    x = rng.random((n, m)) < 0.5
    eta = x @ np.array([2.0, -1.5, 1.0, 0.0, -2.5])
    grades = (eta + rng.logistic(size=n) > -1.5).astype(int) + (eta + rng.logistic(size=n) > 1.0)
    grades = np.minimum(grades, 2)
    offsets, slots = np.r_[0, np.cumsum(x.sum(1))], np.concatenate([np.flatnonzero(r) for r in x])
    often, mean = x.sum(0), np.array([grades[x[:, j]].mean() for j in range(m)])
    scale = np.minimum(np.abs(mean - grades.mean()) * np.sqrt(often) / grades.std() / 5.0, 1.0) ** 2

    def loss(v):
        lin, t = x @ (v[:m] * scale), np.r_[-np.inf, v[m], max(v[m], v[m + 1]), np.inf]
        cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return -np.log(np.maximum(cdf(t[grades + 1] - lin) - cdf(t[grades] - lin), 1e-9)).mean() + 0.5e-3 * (v[:m] ** 2).sum()

    v, rate = np.r_[np.zeros(m), -1.0, 1.0], 1.0
    for _ in range(1500):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(m + 2) * 1e-5])
        while loss(v - rate * g) > loss(v) and rate > 1e-9:
            rate /= 2
        v, rate = v - rate * g, rate * 1.5
    w, t = quality.fit(grades, offsets, slots, rounds=4000, penalty=1e-3)
    assert np.allclose(w[:m], v[:m] * scale, atol=0.05) and np.allclose(t, v[m:], atol=0.05)


def found(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    return {tuple(r) for r in topk.search(df, k).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_search_equals_brute_force(spark, seed, tables):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    assert found(spark, rows) == brute.topk(rows)
    real = [tuple(r) for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in QUERIES["op10_topk"](spark, tables).collect()} == brute.topk(real)


def test_search_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.0]), (20, None), (40, [nan, 1.0]), (60, [1.0, None]), (80, [0.0, 0.0]), (1, [inf, 0.0]), *[(i, [0.5, 0.25]) for i in range(2, 40) if i != 20], (100, [-3.0, -2.0])]
    assert found(spark, rows) == brute.topk(rows)
    assert found(spark, [(0, [1.0]), (1, [2.0]), (2, [0.1])]) == {(0, 1, 1, 8192), (0, 2, 2, 384)}
    assert found(spark, []) == set() and found(spark, [(20, [1.0])]) == set()
    # beyond exact doubles, still exact
    assert found(spark, [(0, [3.0e7]), (1, [2.0e7 + 1, 5.0]), (2, [1.0e7])], 2) == {(0, 1, 1, 1920000000 * 1280000064), (0, 2, 2, 1920000000 * 640000000)}


def test_search_refuses_scores_beyond_64_bits_and_skips_rows_without_id(spark):
    for v in (1e200, 1e308):
        with pytest.raises(Exception, match="64 bits"):
            found(spark, [(0, [v]), (1, [1.0])])
    assert found(spark, [(0, [1.0]), (None, [9.0]), (1, [2.0]), (2, []), (3, [1.0, 5.0])]) == {(0, 1, 1, 8192), (0, 2, 3, 4096), (0, 3, 2, 0)}


def test_search_over_many_pivots_and_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES", 10)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6)) * 3
    rows = [(i, (centres[i % 9] + 0.1 * rng.normal(size=6)).tolist()) for i in range(700)] + [(1000 + i, [0.25] * 6) for i in range(300)]
    assert found(spark, rows, 6) == brute.topk(rows, 6)
    assert found(spark, [(i, [4.0e6 * x for x in v]) for i, v in rows], 6) == brute.topk([(i, [4.0e6 * x for x in v]) for i, v in rows], 6)


def test_search_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(640)] + [(20, [1.0, 2.0, 0.0, 0.0])]
    assert {r[:1] + r[2:] for r in found(spark, rows[:640], 5)} == {r[:1] + r[2:] for r in brute.topk(rows[:640], 5)}


def test_search_gives_each_repeated_row_its_own_neighbours(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(640)]
    rows += [(20, [1.0, 2.0, 0.0, 0.0]), rows[40], rows[40], rows[7]]  # an id with two vectors, a row three times, a repeated candidate
    for part, k in ((rows, 5), (rows[20:21] * 90, 20)):
        df = spark.createDataFrame(part, "vec_id long, embedding array<double>")
        got = [tuple(r) for r in topk.search(df, k).collect()]
        # brute force over row numbers, of which the queries' are divisible by every and the others not
        names, at = {}, {True: 0, False: 1}
        for i, v in part:
            q = i % 20 == 0
            names[at[q]] = (i, v)
            at[q] += 20 if q else 1
            at[q] += int(not q and at[q] % 20 == 0)
        scored = brute.topk([(key, v) for key, (_, v) in names.items()], len(part))
        lists = {}
        for q, _, x, s in scored:
            lists.setdefault(q, []).append((-s, names[x][0]))
        want = [(names[q][0], r + 1, i, -s) for q, found_ in lists.items() for r, (s, i) in enumerate(sorted(found_)[:k])]
        assert sorted(got) == sorted(want)


def test_all_links_inside_components_are_counted(spark, tables):
    import random

    rng = random.Random(8)
    rows, n = [], 0
    for g in range(6):  # groups of edited copies, some of them equal
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(60)] = f"x{rng.randrange(3)}"
            rows.append((n := n + 1, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "alone " * 9)]
    for part in (rows, texts(spark, tables)[:400]):
        label = {d: c for d, (_, c) in brute.jaccard(part, 5, 80).items()}
        sets = {d: (set(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()) for d, t in part for w in [(t or "").lower().encode().split()]}
        want = {c: [list(label.values()).count(c), 0] for c in label.values()}
        for i, a in enumerate(sorted(sets)):
            for b in sorted(sets)[i + 1 :]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    want[label[a]][1] += 1
        got = {r.component_id: [r.n_docs, r.n_links] for r in ngram_join.links(docs_of(spark, part)).collect()}
        assert got == want
    assert max(v[1] for v in want.values()) > 1
