import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from against_sql import same
from quadrat.llm import decontamination, mixing, pii, url_filters
from quadrat.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, w string, h string, size string, label string"


def docs_of(spark, rows):
    """Documents with more columns than needed, some of whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, 0, "w", "h", "s", "l") for i, t, s in rows], DOCS)


def plain(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    assert same(spark, tables, QUERIES[name], ORACLES[name])


# decontamination

PASSAGE = " ".join(f"p{i}" for i in range(20))
COLS1 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_cases(spark):
    long = " ".join(f"f{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, "... !!!"), (4, PASSAGE), (5, f"Ünder {PASSAGE.upper()}, après"), (6, f"{long} {PASSAGE} {long}"), (7, " ".join(f"p{i}" for i in range(12))), (8, f"{PASSAGE} x {PASSAGE}"),
        (4, PASSAGE), (9, "two words"), (10, "one two words here"), (11, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"), (None, PASSAGE), (None, "nothing"), (12, "日本 語 p1"), (13, "a_b-c p1"),
    ]
    items = [(1, PASSAGE), (2, "Two words!"), (3, None), (4, ""), (5, PASSAGE), (20, "日本 語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.judge(docs_of(spark, [(i, t, "s") for i, t in rows]), bench))
    assert plain(got, *COLS1) == sorted(brute.decontamination(rows, items), key=str)
    kept = decontamination.clean(docs_of(spark, [(i, t, "s") for i, t in rows]), bench)
    bad = {r[0] for r in brute.decontamination(rows, items) if r[5] and r[0] is not None}
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - bad


def test_decontamination_random_overlaps(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(6)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(12)]
    got = decontamination.digest(decontamination.judge(docs_of(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")))
    assert plain(got, *COLS1) == sorted(brute.decontamination(rows, items), key=str)


def test_decontamination_with_a_coarse_set(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SET", 4)
    rows, items = [(1, PASSAGE), (2, "a b c d e f g h i j k l m n o p")], [(1, PASSAGE), (2, " ".join(f"q{i}" for i in range(40)))]
    got = decontamination.digest(decontamination.judge(docs_of(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")))
    assert plain(got, *COLS1) == sorted(brute.decontamination(rows, items), key=str)


def test_few_words_pass_the_filter_of_a_million_windows(spark):
    from pyspark.sql import functions as F

    word = lambda c: F.concat(F.lit("w"), F.pmod(F.xxhash64(c), F.lit(200_000)).cast("string"))
    text = lambda n, seed: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: word(F.struct(F.col("id"), i, F.lit(seed)))), " ")
    bench = spark.range(2000).select(F.col("id").alias("item_id"), text(512, 1).alias("text"))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), text(1000, 2).alias("text"))
    found = decontamination.hits(docs, bench)
    assert 100 <= found.count() < 300 and found.filter("items is not null").isEmpty()
    taken = bench.limit(1).select(F.lit(7).cast("long").alias("doc_id"), "text")
    (row,) = decontamination.judge(docs.filter("doc_id <> 7").union(taken), bench).filter("contaminated").collect()
    assert (row.doc_id, row.n_hit) == (7, 512)


def test_decontamination_of_nothing(spark):
    none, some = docs_of(spark, []), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert decontamination.judge(none, some).count() == 0
    got = decontamination.digest(decontamination.judge(docs_of(spark, [(1, PASSAGE, "s")]), some.filter("false")))
    assert plain(got, "doc_id", "n_words", "n_hit", "contaminated") == [(1, 20, 0, False)]


# personal data

TEXTS = [
    None, "", "mail a@b.c, x@y.zz.q- and a@b.c_d@e.f end", "@a.b a@b @@ a@@b.c", "é🎉 me@ex.org 🎉 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255",
    "card 4785380592391139 and 4785-3805 9239 1138, 4111 1111 1111 1111 99 12345678901234567890", "+1 (555) 010-9999 ++49 30 1234567 +12 +123456789012345678", "1" * 3000, "1 " * 3000, "a" * 3000 + "@x.y", "+1" + "(" * 2000,
    " ".join(f"u{i}@h{i}.com" for i in range(700)), "a.b@c.d.e.f" * 50, "iban DE89370400440532013000 or GB82 WEST 1234 5698 7654 32, not DE89370400440532013001", "ssn 123-45-6789 but 123-45-6789 no",
]


def test_pii_base_spans(spark):
    found = pii.digest(pii.find(docs_of(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])))
    for r in found.collect():
        want = brute.pii(TEXTS[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want)), (r.doc_id, want[:3], r.spans[:90])
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(x[0] == k for x in want) for k in brute.KINDS]


def test_pii_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789012345 .-+@()ab_%é") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for r in pii.digest(pii.find(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]))).collect():
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(texts[r.doc_id]))), texts[r.doc_id]


def test_pii_adds_confirmed_numbers_and_context(spark):
    got = {r.doc_id: r for r in pii.find(docs_of(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])).collect()}
    assert [TEXTS[13][s.start : s.end] for s in got[13].iban] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    assert [(s.start, round(s.score, 3)) for s in got[14].ssn] == [(4, 0.6)]
    assert got[2].email[0].score == 1.0


def test_pii_account_numbers_end_with_their_own_words(spark):
    de, gb, spaced = "DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"
    cases = [
        (f"{de} BIC COBADEFFXXX", [de]), (f"{spaced} EUR 500", [spaced]), (f"{de} 2024-05-01", [de]), (f"{de} {gb}", [de, gb]), (f"AB12 CD34 {spaced} X", [spaced]), (f"é🎉 {de}é {de}x {de}9 {gb}", [gb]),
        ("NO9386011117947 NOK", ["NO9386011117947"]), (" ".join([de] * 600), [de] * 600), ("XA61 1234 5678 9012 ABC", ["XA61 1234 5678 9012"]),
    ]
    texts = [t for t, _ in cases]
    for r in pii.find(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        got = [texts[r.doc_id][s.start : s.end] for s in r.iban]
        want = cases[r.doc_id][1]
        # é ends no word in some versions of the matcher
        assert got == want or (r.doc_id == 5 and got == [de, gb]), texts[r.doc_id][:80]


def test_pii_context_on_both_sides_and_past_matches(spark):
    a, b, c = "123-45-6789", "234-56-7890", "345-67-8901"
    cases = [
        (f"{a} (SSN)", [a]), (f"SSN: {a}, {b}, {c}", [a, b, c]), (f"{a} and {b} are ssn", [a, b]), (f"ssn {a} but {b} no", [a]), (f"{a} but {b} ssn", [b]), (f"ssn{' ' * 46}{a}", []), (f"ssn{' ' * 45}{a}", [a]),
        (f"xssn {a}", []), (f"{a}{' ' * 45}ssn", [a]), (f"{a}{' ' * 46}ssn", []), (f"{'🎉' * 300} ssn {a} {'é' * 300} {b} ssn", [a, b]), (f"s{'x' * 40}ssn {a}", []),
    ]
    texts = [t for t, _ in cases]
    for r in pii.find(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert [texts[r.doc_id][s.start : s.end] for s in r.ssn] == cases[r.doc_id][1], texts[r.doc_id][-90:]


def test_pii_redaction_keeps_columns_and_clean_text(spark):
    out = {r.doc_id: r.text for r in pii.redact(docs_of(spark, [(1, "to a@b.co now", "s"), (2, "12 plain", "s"), (3, None, "s")])).collect()}
    assert out == {1: "to [email] now", 2: "12 plain", 3: None}
    assert pii.find(docs_of(spark, [])).count() == 0


# mixing


def mixed(spark, rows, **how):
    return mixing.mix(docs_of(spark, rows), **how)


def test_mixing_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(0, 9), rng.choices(["a", "b", None, "c"], [60, 20, 10, 2])[0]) for i in range(3000)]
    got = mixed(spark, rows).collect()
    assert len(got) == 3000 and sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(t - taken) <= 9 for _, t, taken in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(s for s, _, _ in by.values())) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t, _ in by.values())
    # a, b, c, null weigh 5, 2, 1, 5: small ones stop at twice their size, the others share by weight
    free = [k for k in by if by[k][1] < 2 * by[k][0] - 1e-6]
    assert len({round(by[k][1] / {"a": 5, "b": 2, "c": 1, None: 5}[k], 6) for k in free}) <= 1
    assert plain(mixed(spark, rows), "doc_id", "taken") == plain(mixed(spark, rows[::-1]), "doc_id", "taken")


def test_mixing_cases(spark):
    assert mixed(spark, []).count() == 0
    assert plain(mixed(spark, [(1, None, None), (2, "", "a")]), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    got = plain(mixed(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, "c", None)]), "doc_id", "size", "taken")
    assert len(got) == 3 and got[0][2] == got[1][2]
    one = mixed(spark, [(i, "a\tb\x0bc d\u00a0e", "x") for i in range(200)]).collect()
    assert {r.size for r in one} == {4} and abs(sum(r.taken for r in one) - 1200) <= 4


def test_mixing_counts_very_long_texts_and_keeps_columns_of_its_own_names(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "x", "r", 7, 8), (2, "a b", "x", "r", 7, 8), (3, None, None, "r", 7, 8)], "doc_id long, text string, source string, row string, copies int, whole int")
    assert plain(mixing.mix(docs), "doc_id", "size", "taken")[0][1] == 400_000
    (first, *_) = sorted(mixing.take(docs).filter("doc_id = 1").collect())
    assert first.text == long and (first.row, first.copies, first.whole) == ("r", 7, 8)


def test_pii_of_rows_without_an_id(spark):
    docs = docs_of(spark, [(None, "mail a@b.co", "s"), (None, None, "s"), (3, "mail a@b.co", "s"), (3, "mail a@b.co", "s")])
    assert plain(pii.digest(pii.find(docs)), "doc_id", "n_email", "spans") == [(3, 1, "email:5:11"), (3, 1, "email:5:11"), (None, 0, ""), (None, 1, "email:5:11")]
    assert {r.text for r in pii.redact(docs).collect()} == {"mail [email]", None}


def test_mixing_takes_rows_as_often_as_it_says(spark):
    rows = [(i, "word " * (i % 7), f"s{i % 3}") for i in range(400)]
    want = {r.doc_id: r.copies for r in mixed(spark, rows).collect()}
    out = mixing.take(docs_of(spark, rows))
    assert out.columns == docs_of(spark, []).columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: c for i, c in want.items() if c}


# URLs


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://A.Org", "http://a.org/", "https://Example.ORG/es/1?q", "https://x.example.org/en/12#f", "ftp://notexample.org/es/", "http://shop.com/fr/a", "http://com/de/x", "http://evilcom/de/x", "a://b://c/d", "http://h?x=/y", "http://é.com/de/\nz"]
    pages = spark.createDataFrame([(i, u, "h", "a") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, none).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.org", "", None, "allow"), 3: ("a.org", "/", "org/", "allow"), 4: ("example.org", "/es/1", "example.org/es/", "block"),
        5: ("x.example.org", "/en/12", "example.org/en/1", "block"), 6: ("notexample.org", "/es/", "org/", "allow"), 7: ("shop.com", "/fr/a", "com/fr/", "allow"), 8: ("com", "/de/x", "com/de/", "block"),
        9: ("evilcom", "/de/x", None, "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("h", "", None, "allow"), 12: ("é.com", "/de/\nz", "com/de/", "block"),
    }
    assert url_filters.judge(pages.filter("false"), none).count() == 0


def test_reputation_blocks_bad_hosts_and_shrinks(spark):
    rows, told, n = [], [], 0
    for host, pages, bad in (("bad.spam.net", 60, 58), ("good.fine.net", 60, 2), ("once.fine.net", 1, 1), ("new.spam.net", 1, None)):
        for k in range(pages):
            rows.append((n, f"http://{host}/en/{k}"))
            if bad is not None:
                told.append((n, int(k < bad)))
            n += 1
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*told, (0, None)], "page_id long, bad int")
    got = {(r.host, r.verdict) for r in url_filters.judge(pages, outcomes).collect()}
    # a host without outcomes has what its domain has; a host with one bad page does not outweigh a good domain
    assert got == {("bad.spam.net", "block"), ("good.fine.net", "allow"), ("once.fine.net", "allow"), ("new.spam.net", "block")}
    hosts = spark.createDataFrame([("a.x.net", 10, 9), ("b.x.net", 0, 0), ("c.y.net", 0, 0), ("d.y.net", 10, 0)], "host string, n long, bad long")
    mean = {r.host: r["mean"] for r in url_filters.reputation(hosts).collect()}
    assert 0.9 > mean["a.x.net"] > mean["b.x.net"] > mean["c.y.net"] > mean["d.y.net"] > 0


def test_suffixes_of_two_labels(spark):
    got = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.com",), ("com",)], "h string").select(url_filters.domain_of(F.col("h")), url_filters.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com")]


def test_native_plans_hold_no_python(spark, tables):
    for name in ("op1_decontamination", "op2_pii", "op3_mixing", "op9_url_filters"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan), name


def test_domains_of_addresses_ports_and_countries(spark):
    from pyspark.sql import functions as F

    want = {
        "10.0.3.4": ("10.0.3.4", ""), "10.9.3.4:80": ("10.9.3.4", ""), "[2001:db8::1]:8080": ("[2001:db8::1]", ""), "host.com:8080": ("host.com", "com"), "a.host.com.": ("host.com", "com"),
        "me:pw@x.host.com": ("host.com", "com"), "a.co.kr": ("a.co.kr", "co.kr"), "b.a.co.kr:1": ("a.co.kr", "co.kr"), "co.kr": ("co.kr", "co.kr"), "x.disco.kr": ("disco.kr", "kr"), "": ("", ""), "localhost": ("localhost", "localhost"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", url_filters.domain_of(F.col("h")), url_filters.suffix_of(F.col("h")))
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == want


def test_url_reputation_by_address_and_missing_ids(spark):
    rows = [(i, f"http://10.0.0.{i % 2}/x", "h") for i in range(60)] + [(None, "http://10.0.0.1/y", "h"), (None, "http://new.co.kr/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 0)], "page_id long, bad int")
    got = {(r.host, r.verdict) for r in url_filters.judge(pages, outcomes).collect()}
    assert got == {("10.0.0.0", "allow"), ("10.0.0.1", "block"), ("new.co.kr", "allow")}
    assert url_filters.judge(pages, outcomes).count() == 62


def test_redaction_covers_all_kinds_and_overlaps(spark):
    iban, wide = "DE89 3704 0044 0532 0130 00", "é🎉" * 300
    rows = [
        (1, f"pay to iban {iban} now"), (2, "my ssn 123-45-6789 is secret"), (3, "card +4111 1111 1111 1111 end"), (4, f"{wide} a@b.co {wide} 10.1.2.3{wide}"),
        (5, "plain"), (6, None), (7, ""), (8, "a@b.co" ), (9, "x " * 5000 + "a@b.co " * 3000),
    ]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, email int, row string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "pay to iban [iban] now" and got[2] == "my ssn [ssn] is secret" and got[4] == f"{wide} [email] {wide} [ip]{wide}"
    assert "1111" not in got[3] and got[3].endswith(" end") and (got[5], got[6], got[7], got[8]) == ("plain", None, "", "[email]")
    assert got[9] == "x " * 5000 + "[email] " * 3000


def test_public_suffixes_with_wildcards_and_exceptions(spark, tmp_path):
    from quadrat.llm import suffixes

    want = {
        "www.mofa.go.jp": ("mofa.go.jp", "go.jp"), "x.me.uk": ("x.me.uk", "me.uk"), "a.x.asn.au": ("x.asn.au", "asn.au"), "go.jp": ("go.jp", "go.jp"), "a.b.shop.ck": ("b.shop.ck", "shop.ck"),
        "a.www.ck": ("www.ck", "ck"), "a.b.c.kobe.jp": ("b.c.kobe.jp", "c.kobe.jp"), "x.city.kobe.jp": ("city.kobe.jp", "kobe.jp"), "ck": ("ck", "ck"), "a.co.example": ("co.example", "example"), "u@x.me.uk.:8": ("x.me.uk", "me.uk"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", url_filters.domain_of(F.col("h")).alias("d"), url_filters.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == want
    path = tmp_path / "rules.dat"
    path.write_text("// a comment\n\nblog.example  after the blank\n*.b.c.example\n!x.b.c.example\n")
    rules = suffixes.lines(spark, str(path))
    assert rules == ("blog.example", "*.b.c.example", "!x.b.c.example")
    want = {"a.me.blog.example": ("me.blog.example", "blog.example"), "z.y.w.b.c.example": ("y.w.b.c.example", "w.b.c.example"), "z.x.b.c.example": ("x.b.c.example", "b.c.example"), "a.co.uk": ("co.uk", "uk")}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", url_filters.domain_of(F.col("h"), rules).alias("d"), url_filters.suffix_of(F.col("h"), rules).alias("s")).collect()}
    assert got == want


def test_reputation_of_public_suffixes_equals_sql(spark, tmp_path):
    from quadrat.llm.queries import ORACLES, QUERIES

    hosts = ["a.x.go.jp", "x.go.jp", "y.go.jp", "www.ck", "b.www.ck", "c.d.ck", "z.me.uk", "1.2.3.4", "n.com", "city.kobe.jp", "k.v.kobe.jp", "v.kobe.jp", "u:p@q.co.nz:80", "q.co.nz.", ""]
    n = 12
    pages = [(i, f"http://{h}/{'a' * 200_000 if i == 0 else i}", "") for i, h in enumerate(h for h in hosts for _ in range(n))]
    labels = [(i, 0 if i // n % 3 == 0 else 1, 1 if i // n % 5 == 2 else 0) for i in range(len(pages))]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")

    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES['op9_url_filters']})").fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES["op9_url_filters"](spark, str(tmp_path)).select(*cols).collect()), key=str)
    assert got == want and len({r[4] for r in got}) == 2
