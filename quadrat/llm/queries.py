"""One query per corpus operator with production parameters, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import decontamination, filter_audit, language_id, merkle, mixing, ngram_join, packing, pii, quality, suffix_dedup, token_files, topk, url_filters
from quadrat.llm.common import table
from quadrat.llm.suffixes import RULES as SUFFIXES


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.encode(table(spark, sf_dir, "documents"), tokenizer_path()))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, similarity=Fraction(90, 100))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad where the label of its id says toxic or low quality: a stand-in, as no table ties pages to documents."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0).alias("bad"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), outcomes(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = filter_audit.audit(filter_audit.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return told.drop("filter")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering adds 1 to n_chars of the rows whose id 7 tells."""
    docs = table(spark, sf_dir, "documents")
    changed = merkle.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    told = merkle.manifest(docs, carry={"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed)})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = told.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(spark, packing.encode(table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_token_files": op4_token_files,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_url_filters": op9_url_filters,
    "op10_topk": op10_topk,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle": op12_merkle,
    "op13_packing": op13_packing,
}

WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: A leaf of a row whose n_chars is {n}.
LEAF_SQL = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text")) + ")"

ORACLES = {
    "op1_decontamination": f"""
WITH b AS (SELECT item_id, w, least(len(w), 13) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT k, array_to_string(w[i:i + k - 1], ' ') AS win, item_id FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
occ AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT k FROM wins) WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, i, k, item_id FROM occ JOIN wins USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS c FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(c, w * max(level) OVER ()) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / greatest(source_size, 1)) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
k AS (SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS up_to FROM g)
SELECT d.doc_id, d.size, u.source_size, u.target, CAST(d.size * (u.whole + CASE WHEN
         u.target - u.whole * u.source_size > 0 AND (k.up_to <= u.target - u.whole * u.source_size OR (k.up_to - k.size <= u.target - u.whole * u.source_size
         AND k.up_to - (u.target - u.whole * u.source_size) <= (u.target - u.whole * u.source_size) - (k.up_to - k.size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h""",
    "op9_url_filters": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
hn AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, regexp_replace(host, '(?s)^.*@|:[0-9]*$|\.+$|\.+(:[0-9]*)$', '', 'g') AS name FROM p LEFT JOIN o USING (page_id) GROUP BY host),
ru AS (SELECT rule, ltrim(rule, '!') AS body, str_split(ltrim(rule, '!'), '.') AS rw, starts_with(rule, '!') AS ex FROM (SELECT unnest(str_split('""" + " ".join(SUFFIXES) + r"""', ' ')) AS rule)),
hw AS (SELECT *, regexp_matches(name, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') AS ip, str_split(name, '.') AS w FROM hn),
tl AS (SELECT host, w, unnest(range(1, len(w) + 1)) AS k FROM hw),
fit AS (SELECT host, max_by(CASE WHEN ex THEN k - 1 ELSE k END, CASE WHEN ex THEN 100000 ELSE k END) AS k
        FROM tl JOIN ru ON len(rw) = k AND (array_to_string(w[-k:], '.') = body OR (starts_with(body, '*.') AND array_to_string(w[len(w) - k + 2:], '.') = body[3:])) GROUP BY host),
hk AS (SELECT hw.*, coalesce(fit.k, 1) AS k FROM hw LEFT JOIN fit ON hw.host = fit.host),
h AS (SELECT host, n, bad, CASE WHEN ip THEN name ELSE array_to_string(w[greatest(len(w) - k, 1):], '.') END AS domain,
             CASE WHEN ip THEN '' ELSE array_to_string(w[len(w) - k + 1:], '.') END AS suffix FROM hk),
a AS (SELECT count(*)::DOUBLE AS m, coalesce(sum(n), 0) AS nn, coalesce(sum(n * n), 0) AS n2, coalesce(sum(bad), 0) AS b, coalesce(sum(n * (bad / greatest(n, 1)) * (bad / greatest(n, 1))), 0) AS r2 FROM h WHERE n > 0),
q AS (SELECT *, CASE WHEN nn > 0 THEN b / greatest(nn, 1) ELSE 0.5 END AS p0, greatest(b - r2, 0) / greatest(nn - m, 1) AS within_, (nn - n2 / greatest(nn, 1)) / greatest(m - 1, 1) AS n0 FROM a),
q2 AS (SELECT *, greatest(r2 - nn * p0 * p0, 0) / greatest(m - 1, 1) AS between_ FROM q),
q3 AS (SELECT p0, 1.0 / least(greatest((between_ - within_) / greatest(between_ + (n0 - 1) * within_, 1e-9), 0.001), 0.5) - 1 AS k FROM q2),
s AS (SELECT suffix, (sum(bad) + max(k) * max(p0)) / (sum(n) + max(k)) AS ps FROM h, q3 GROUP BY suffix),
m AS (SELECT domain, (sum(bad) + max(k) * max(ps)) / (sum(n) + max(k)) AS pd FROM h JOIN s USING (suffix), q3 GROUP BY domain),
ab AS (SELECT host, bad + k * pd AS a, n - bad + k * (1 - pd) AS b FROM h JOIN m USING (domain), q3),
bl AS (SELECT host FROM ab WHERE host <> '' AND a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bl.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN bl ON r.host = bl.host""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
e AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, z.x] AS o, array_to_string(list_transform([a.x, b.x, c.x, d.x, z.x], lambda k: 'ABCDE'[k]), '') AS filter_order
      FROM e a, e b, e c, e d, e z WHERE len(list_distinct([a.x, b.x, c.x, d.x, z.x])) = 5),
s AS (SELECT o, filter_order, x AS step, o[x] AS flt FROM o, e),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM j GROUP BY ALL),
r AS (SELECT part, filter_order, step, flt, fails[flt] AS f, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda k: k)) AS many, good, toxic, n FROM g, s),
a AS (SELECT part, filter_order, step, flt, sum(CASE WHEN NOT gone AND NOT f THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND f THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND f THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f AND many = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND f AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND f AND toxic THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, flt))::BIGINT AS shapley FROM a""",
    "op12_merkle": f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {LEAF_SQL.format(n="n_chars")} AS leaf, {LEAF_SQL.format(n="(n_chars + 1)")} AS changed,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
                             lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) AS c FROM documents, crc),
l AS (SELECT doc_id, g, leaf, CASE WHEN c % 7 = 0 THEN changed ELSE leaf END AS claimed, row_number() OVER () AS rid, count(*) OVER (PARTITION BY g) AS n,
             row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low(lvl, g, pos, n, h) AS (SELECT 0, g, pos, n, leaf FROM l UNION ALL
  SELECT lvl + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, g, pos // 2, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
way AS (SELECT rid, v.lvl AS step, (l.pos >> v.lvl) & 1 AS odd, x.h FROM l JOIN (SELECT DISTINCT g, lvl FROM low WHERE n > 1) v USING (g)
          LEFT JOIN low x ON x.g = l.g AND x.lvl = v.lvl AND x.pos = xor(l.pos >> v.lvl, 1)
        UNION ALL SELECT rid, 1000 + v.lvl, (s.pos >> v.lvl) & 1, x.h FROM l JOIN s USING (g), (SELECT DISTINCT lvl FROM top WHERE n > 1) v
          LEFT JOIN top x ON x.lvl = v.lvl AND x.pos = xor(s.pos >> v.lvl, 1)),
p AS (SELECT rid, list({{'odd': odd, 'h': h}} ORDER BY step) AS path FROM way GROUP BY rid),
f AS (SELECT doc_id, leaf, subroot, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.h), ''), '')) AS proof_sha256,
             list_reduce(list_prepend({{'odd': 0::BIGINT, 'h': claimed}}, coalesce(path, [])), lambda a, x: {{'odd': 0::BIGINT,
               'h': sha256(CASE WHEN x.h IS NULL THEN a.h WHEN x.odd = 1 THEN x.h || a.h ELSE a.h || x.h END)}}).h AS folded_root
      FROM l JOIN s USING (g) LEFT JOIN p USING (rid))
SELECT doc_id, leaf, subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified FROM f, (SELECT h FROM top WHERE n = 1) r""",
}
