"""The named queries once more, in plain SQL for another engine: models as common table expressions, operators written out."""

from __future__ import annotations

from quadrat.functions import draws

E = """
ev AS (SELECT user_id, event_type, value, hour(ts) AS hour FROM events),
ecell AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS av FROM ev GROUP BY ALL),
esp AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS species FROM (SELECT DISTINCT event_type FROM events)),
espec AS (SELECT species, (species % 3 + 1)::INT AS family, (1 + (species % 3) * 0.25)::DOUBLE AS sigma FROM esp),
y AS (SELECT user_id AS site, species, CASE WHEN (user_id + species) % 7 <> 0 THEN CASE species % 3 WHEN 0 THEN av / 100 WHEN 1 THEN (av > 50)::INT::DOUBLE ELSE n::DOUBLE END END AS y FROM ecell JOIN esp USING (event_type)),
eh AS (SELECT user_id, avg(hour) AS h FROM ev GROUP BY user_id),
x AS (SELECT user_id AS site, 0 AS cov, 1.0::DOUBLE AS x FROM eh UNION ALL SELECT user_id, 1, (h - 12) / 6 FROM eh),
pi AS (SELECT user_id AS site, 0 AS level, (user_id % 10)::INT AS unit FROM eh UNION ALL SELECT user_id, 1, (user_id % 7)::INT FROM eh),
beta AS (SELECT cov, species, ((cov * 3 + species * 2) % 5 - 2) / 4.0::DOUBLE AS v FROM espec, (SELECT unnest([0, 1]) AS cov)),
eta AS (SELECT level, unit, h, ((unit * 7 + h * 3 + level * 5) % 11 - 5) / 5.0::DOUBLE AS v FROM (SELECT DISTINCT level, unit FROM pi), (SELECT unnest([0, 1, 2]) AS h)),
lam AS (SELECT level, h, species, ((species * 5 + h * 3 + level * 2) % 7 - 3) / 10.0::DOUBLE AS v FROM espec, (SELECT unnest([0, 1]) AS level), (SELECT unnest([0, 1, 2]) AS h)),
lfix AS (SELECT site, species, sum(x * v) AS f FROM x JOIN beta USING (cov) GROUP BY ALL),
lran AS (SELECT site, lam.species, sum(eta.v * lam.v) AS r FROM pi JOIN eta USING (level, unit) JOIN lam USING (level, h) GROUP BY ALL),
l AS (SELECT site, species, f + r AS l FROM lfix JOIN lran USING (site, species)),
cells AS (SELECT site, species, family, sigma, y, l FROM y JOIN l USING (site, species) JOIN espec USING (species))"""

B = """
br AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS species FROM (SELECT DISTINCT p_brand FROM part)),
spec AS (SELECT species, (0.5 + (species % 4) * 0.25)::DOUBLE AS sigma FROM br),
per AS (SELECT o_custkey AS site, species, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN br USING (p_brand) GROUP BY ALL),
y AS (SELECT c_custkey AS site, spec.species, coalesce(n, 0)::DOUBLE AS y FROM customer CROSS JOIN spec LEFT JOIN per ON per.site = c_custkey AND per.species = spec.species),
seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS seg FROM (SELECT DISTINCT c_mktsegment FROM customer)),
x AS (SELECT c_custkey AS site, cov, CASE cov WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN c_acctbal / 10000 ELSE (seg = cov - 1)::INT::DOUBLE END AS x FROM customer JOIN seg USING (c_mktsegment), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS cov)),
pi AS (SELECT c_custkey AS site, 0 AS level, c_nationkey AS unit FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 1, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
pm AS (SELECT species, avg(p_size) AS size, avg(p_retailprice) AS price FROM part JOIN br USING (p_brand) GROUP BY species),
tr AS (SELECT species, trait, CASE trait WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN size / 50 ELSE price / 2000 END AS t FROM pm, (SELECT unnest([0, 1, 2]) AS trait)),
tk AS (SELECT species, p_type, row_number() OVER (PARTITION BY species ORDER BY count(*) DESC, p_type) AS k FROM part JOIN br USING (p_brand) GROUP BY species, p_type),
tax AS (SELECT species, 0 AS rank, (species % 5)::VARCHAR AS taxon FROM spec UNION ALL SELECT species, 1, p_type FROM tk WHERE k = 1),
beta AS (SELECT cov, species, ((cov * 3 + species * 2) % 5 - 2) / 4.0::DOUBLE AS v FROM spec, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS cov)),
eta AS (SELECT level, unit, h, ((unit * 7 + h * 3 + level * 5) % 11 - 5) / 5.0::DOUBLE AS v FROM (SELECT DISTINCT level, unit FROM pi), (SELECT unnest([0, 1, 2]) AS h)),
lam AS (SELECT level, h, species, ((species * 5 + h * 3 + level * 2) % 7 - 3) / 10.0::DOUBLE AS v FROM spec, (SELECT unnest([0, 1]) AS level), (SELECT unnest([0, 1, 2]) AS h)),
gamma AS (SELECT cov, trait, ((cov + trait * 2) % 3 - 1) / 5.0::DOUBLE AS v FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS cov), (SELECT unnest([0, 1, 2]) AS trait)),
iv AS (SELECT c1, c2, CASE WHEN c1 = c2 THEN 2.0 ELSE 0.1 END::DOUBLE AS v FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c1), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c2)),
cells AS (SELECT site, species, CASE WHEN (site + species) % 7 <> 0 THEN y / 10 END AS z, CASE WHEN (site + species) % 7 <> 0 THEN 1 / (sigma * sigma) ELSE 0 END AS id FROM y JOIN spec USING (species)),
psi AS (SELECT level, h, species, (1 + (h + species) % 3 * 0.5)::DOUBLE AS v FROM lam),
delta AS (SELECT DISTINCT level, h, (1 + h * 0.5 + level * 0.25)::DOUBLE AS v FROM lam),
tau AS (SELECT level, h, v AS delta, product(v) OVER (PARTITION BY level ORDER BY h ROWS UNBOUNDED PRECEDING) AS tau FROM delta),
resid AS (SELECT b.cov, b.species, b.v - m.m AS v FROM beta b JOIN (SELECT cov, species, sum(v * t) AS m FROM gamma JOIN tr USING (trait) GROUP BY ALL) m USING (cov, species)),
scov AS (SELECT unnest([0, 1, 1]) AS sel, unnest([1, 2, 3]) AS cov),
ssp AS (SELECT 0 AS sel, species, species % 2 AS grp FROM spec UNION ALL SELECT 1, species, species % 3 FROM spec),
sact AS (SELECT DISTINCT sel, grp, (sel + grp) % 2 = 0 AS active, CASE sel WHEN 0 THEN 0.3 ELSE 0.6 END::DOUBLE AS q FROM ssp),
mask AS (SELECT cov, species, coalesce(min(active::INT), 1)::DOUBLE AS mask FROM (SELECT DISTINCT cov, species FROM beta) LEFT JOIN (SELECT cov AS c, ssp.species AS s, active FROM scov JOIN ssp USING (sel) JOIN sact USING (sel, grp)) ON c = cov AND s = species GROUP BY ALL),
xr AS (SELECT c_custkey AS site, k, ((c_custkey * (k + 2)) % 7 - 3) / 3.0::DOUBLE AS x FROM customer, (SELECT unnest([0, 1, 2]) AS k))"""
G = """
u AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings),
kn AS (SELECT label AS j, avg(embedding[1]::DOUBLE) AS px, avg(embedding[2]::DOUBLE) AS py FROM embeddings GROUP BY label),
eta AS (SELECT vec_id AS unit, h, embedding[3 + h]::DOUBLE AS v FROM embeddings, (SELECT unnest([0, 1]) AS h)),
grid AS (SELECT unnest([0, 1, 2, 3]) AS g, unnest([0.0, 0.05, 0.2, 1.0])::DOUBLE AS alpha, unnest([0.4, 0.2, 0.2, 0.2])::DOUBLE AS pw)"""
D2 = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))"
W = f"CASE WHEN alpha = 0 THEN CASE WHEN {D2} = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-{D2} / alpha) END"


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0::DOUBLE"


def on(bed: str, query: str) -> str:
    return f"WITH {bed}\n{query}"


PG_S = "CASE WHEN abs(l - ln(1000.0::DOUBLE)) < 0.01 THEN 1.0 ELSE abs(l - ln(1000.0::DOUBLE)) END"
PG = f"""{E},
pg AS (SELECT *, coalesce(y, 0) AS y0, {PG_S} AS s, abs(l - ln(1000.0::DOUBLE)) AS a FROM cells),
pgm AS (SELECT *, CASE WHEN a < 0.01 THEN (y0 + 1000) / 4 * (1 - a * a / 12) ELSE (y0 + 1000) * tanh(s / 2) / (2 * s) END AS m,
        CASE WHEN a < 0.01 THEN sqrt((y0 + 1000) / 24 * (1 - a * a / 5)) ELSE sqrt((y0 + 1000) * (2 * tanh(s / 2) - s / (cosh(s / 2) * cosh(s / 2))) / (4 * s * s * s)) END AS sd FROM pg)"""
SHR = """cell AS (SELECT level, h, species, lam.v AS lv, psi.v AS psi, delta, tau FROM lam JOIN psi USING (level, h, species) JOIN tau USING (level, h))"""
DRAWS = "d AS (SELECT user_id AS param, (event_id % 2)::INT AS chain, event_id AS draw, value AS v FROM events)"
KNN = f"nn AS (SELECT a.i, b.i AS j, {D2} AS d, row_number() OVER (PARTITION BY a.i ORDER BY {D2}, b.i) AS rank FROM u a JOIN u b ON b.i < a.i)"

MODEL_DRAWS = f"""{E}, ds AS (
    SELECT chain, draw, 'Beta' AS param, -1 AS level, cov AS i, species AS j, v + draw / 10.0::DOUBLE + chain AS v FROM beta, (SELECT unnest(range(10)) AS draw), (SELECT unnest([0, 1]) AS chain)
    UNION ALL SELECT chain, draw, 'rho', -1, 0, 0, (SELECT count(*) FROM beta) % 7 FROM (SELECT unnest(range(10)) AS draw), (SELECT unnest([0, 1]) AS chain)
    UNION ALL SELECT chain, draw, 'Eta', level, unit, h, v * (1 + draw) FROM
        (SELECT level, unit, h, ((unit * 7 + h * 3 + level * 5) % 11 - 5) / 5.0::DOUBLE AS v FROM (SELECT 0 AS level, unnest(range(10)) AS unit UNION ALL SELECT 1, unnest(range(7))), (SELECT unnest([0, 1, 2]) AS h)),
        (SELECT unnest(range(10)) AS draw), (SELECT unnest([0, 1]) AS chain))"""
EVENT_DRAWS = "d AS (SELECT event_type AS param, user_id // 2 AS i, (user_id % 2)::INT AS chain, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS draw, value AS v FROM events)"
PLACE = "st AS (SELECT site, (row_number() OVER (ORDER BY site) - 1)::INT AS place FROM (SELECT DISTINCT site FROM x))"
TWO = f"""{G}, {KNN},
    p AS (SELECT u.i, u.px, u.py, a.j AS j1, a.d AS d1, b.j AS j2, b.d AS d2 FROM u LEFT JOIN nn a ON a.i = u.i AND a.rank = 1 LEFT JOIN nn b ON b.i = u.i AND b.rank = 2),
    q AS (SELECT p.*, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS d12 FROM p LEFT JOIN u a ON a.i = j1 LEFT JOIN u b ON b.i = j2),
    k AS (SELECT g, i, j1, j2, exp(-d1 / alpha) AS k1, exp(-d2 / alpha) AS k2, exp(-d12 / alpha) AS k12 FROM q, grid WHERE alpha > 0),
    w AS (SELECT *, CASE WHEN j2 IS NULL THEN k1 ELSE (k1 - k12 * k2) / (1 - k12 * k12) END AS w1, CASE WHEN j2 IS NOT NULL THEN (k2 - k12 * k1) / (1 - k12 * k12) END AS w2 FROM k),
    s AS (SELECT *, 1 / sqrt(1 - coalesce(k1 * w1, 0) - coalesce(k2 * w2, 0)) AS s FROM w)"""



def uniform_sql(rows: str, seed: int, chain: str, iteration: str, cell: str, name: str, stream: int = 0) -> str:
    """rows, with a uniform number: Threefry's rounds, each a select around the one before."""
    m = draws.WORD

    def rounds(inner: str) -> str:
        for n in range(draws.ROUNDS):
            t = draws.ROTATIONS[n % 8]
            inner = f"(SELECT * REPLACE ((x0 + x1) & {m} AS x0, xor(((x1 << {t}) & {m}) | (x1 >> {32 - t}), (x0 + x1) & {m}) AS x1) FROM {inner})"
            if n % 4 == 3:
                i = n // 4 + 1
                k = ("k0", "k1", f"xor(xor(k0, k1), {draws.PARITY})")
                inner = f"(SELECT * REPLACE ((x0 + {k[i % 3]}) & {m} AS x0, (x1 + {k[(i + 1) % 3]} + {i}) & {m} AS x1) FROM {inner})"
        return inner

    one = rounds(f"(SELECT *, {seed & m}::BIGINT AS k0, {seed >> 32 & m}::BIGINT AS k1, (({chain})::BIGINT + {seed & m}) & {m} AS x0, (({iteration})::BIGINT + {seed >> 32 & m}) & {m} AS x1 FROM {rows})")
    two = f"(SELECT * REPLACE (x0 AS k0, xor(x1, {stream}) AS k1, ((({cell})::BIGINT >> 32) + x0) & {m} AS x0, ((({cell})::BIGINT & {m}) + xor(x1, {stream})) & {m} AS x1) FROM {one})"
    return f"(SELECT * EXCLUDE (k0, k1, x0, x1), ((x0 >> 5) * 67108864.0::DOUBLE + (x1 >> 6) + 0.5) / 9007199254740992.0::DOUBLE AS {name} FROM {rounds(two)})"


def horner(x: str, terms) -> str:
    return "".join(["("] * (len(terms) - 1)) + f"{terms[-1]!r}::DOUBLE" + "".join(f" * ({x}) + {t!r}::DOUBLE)" for t in reversed(terms[:-1]))


def quantile_sql(p: str) -> str:
    """The normal quantile."""
    of = lambda x, f: f"{horner(x, f[0])} / {horner(x, f[1])}"
    root = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"0.180625::DOUBLE - ({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE)"
    return f"(CASE WHEN abs({p} - 0.5::DOUBLE) <= 0.425 THEN ({p} - 0.5::DOUBLE) * {of(centre, draws.CENTRE)} ELSE sign({p} - 0.5::DOUBLE) * (CASE WHEN {root} <= 5 THEN {of(f'{root} - 1.6::DOUBLE', draws.NEAR)} ELSE {of(f'{root} - 5', draws.FAR)} END) END)"


def tail_sql(a: str) -> str:
    """The probability of a normal beyond a > 0."""
    return f"(exp(-({a}) * ({a}) / 2) * CASE WHEN {a} < 7.07106781186547 THEN {horner(a, draws.TAIL[0])} / {horner(a, draws.TAIL[1])} ELSE 1 / (({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) * 2.506628274631::DOUBLE) END)"


def inverse_sql(name: str, matrices: str, out: str) -> str:
    """Recursive tables: matrices(g, a), lists of rows, by Gauss and Jordan into out(g, n, a, ld), a being the inverse and ld the log of the determinant."""
    step = """list_transform(a, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / a[k + 1][k + 1])
        ELSE list_transform(row, lambda v, j: v - row[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END)"""
    return f"""{name}(g, n, k, a, ld) AS (SELECT g, len(a), 0, list_transform(a, lambda row, i: list_concat(row, list_transform(range(len(a)), lambda j: CASE WHEN j = i - 1 THEN 1.0::DOUBLE ELSE 0 END))), 0.0::DOUBLE FROM {matrices}
        UNION ALL SELECT g, n, k + 1, {step}, ld + ln(a[k + 1][k + 1]) FROM {name} WHERE k < n),
    {out} AS (SELECT g, n, list_transform(a, lambda row: row[n + 1:]) AS a, ld FROM {name} WHERE k = n)"""


KNOTS = f"""{G},
    w22 AS (SELECT g, list(r ORDER BY i) AS a FROM (SELECT g, a.j AS i, list({W} ORDER BY b.j) AS r FROM kn a, kn b, grid GROUP BY g, a.j) GROUP BY g),
    {inverse_sql("gj", "w22", "i22")},
    w12 AS (SELECT g, a.i, list({W} ORDER BY b.j) AS w FROM u a, kn b, grid GROUP BY g, a.i),
    dd AS (SELECT g, i, w, greatest(1 - list_dot_product(w, list_transform(a, lambda row: list_dot_product(row, w))), 1e-9) AS dd FROM w12 JOIN i22 USING (g)),
    sc AS (SELECT g, i, k, w[k] AS wk, w, dd FROM dd, (SELECT unnest(range(1, 11)) AS k)),
    fm AS (SELECT g, k, l, w22.a[k][l] + v AS v FROM (SELECT g, k, l, sum(wk * w[l] / dd) AS v FROM sc, (SELECT unnest(range(1, 11)) AS l) GROUP BY ALL) JOIN w22 USING (g))"""

SEED, CHAIN, ITERATION = 20240607, 1, 17
CELL_DRAWS = uniform_sql(uniform_sql("pgm", SEED, str(CHAIN), str(ITERATION), "site * 64 + species", "u0"), SEED, str(CHAIN), str(ITERATION), "site * 64 + species", "u1", 1)
JOINT = f"""{B},
    f AS (SELECT site, cov AS k, x FROM x UNION ALL SELECT site, 6 + level * 3 + h, v FROM pi JOIN eta USING (level, unit)),
    rhs AS (SELECT species, k AS a, sum(id * x * coalesce(z, 0)) AS v FROM cells JOIN f USING (site) GROUP BY ALL
            UNION ALL SELECT species, c1, sum(iv.v * gamma.v * t) FROM iv JOIN gamma ON cov = c2 JOIN tr USING (trait) GROUP BY ALL)"""
ALIKE = f"""{B},
    alike AS (SELECT a.species AS s1, b.species AS s2, avg((a.taxon = b.taxon)::INT::DOUBLE) AS c FROM tax a JOIN tax b USING (rank) GROUP BY ALL),
    gr AS (SELECT g::INT AS g, g / 12.0::DOUBLE AS rho, CASE WHEN g = 0 THEN 0.5 ELSE 0.05 END::DOUBLE AS pw FROM (SELECT unnest(range(11)) AS g)),
    qm AS (SELECT g, list(r ORDER BY s1) AS a FROM (SELECT g, s1, list(rho * c + CASE WHEN s1 = s2 THEN 1 - rho ELSE 0 END ORDER BY s2) AS r FROM alike, gr GROUP BY g, s1) GROUP BY g),
    {inverse_sql("gq", "qm", "qi")}"""
CHI = f"""ki AS (SELECT i, unnest(range((n + 9) // 2)) AS k, n FROM (SELECT count(*) AS n FROM spec), (SELECT unnest(range(6)) AS i)),
    kk AS MATERIALIZED (SELECT i, k, n + 7 - i - 2 * k AS left_over FROM ki WHERE n + 7 - i - 2 * k > 0),
    ku AS MATERIALIZED (SELECT * FROM {uniform_sql("kk", SEED, str(CHAIN), str(ITERATION), "(i::BIGINT << 32) + k", "u", 2)}),
    kw AS MATERIALIZED (SELECT * FROM {uniform_sql("ku", SEED, str(CHAIN), str(ITERATION), "i", "w", 3)}),
    kz AS MATERIALIZED (SELECT *, {quantile_sql("w")} AS z FROM kw),
    ch AS (SELECT i, sum(CASE WHEN left_over = 1 THEN z * z ELSE -2 * ln(u) END) AS v FROM kz GROUP BY i),
    lo AS MATERIALIZED (SELECT a * 6 + b AS cell FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a > b),
    lv AS (SELECT sum({quantile_sql("u")} * {quantile_sql("u")}) AS v FROM {uniform_sql("lo", SEED, str(CHAIN), str(ITERATION), "cell", "u", 4)}),
    sm AS (SELECT 0 AS g, list(r ORDER BY a) AS a FROM (SELECT x.cov AS a, list(x.v + iv.v ORDER BY x.cov2) AS r FROM (SELECT p.cov, q.cov AS cov2, sum(p.v * q.v) AS v FROM resid p JOIN resid q USING (species) GROUP BY ALL) x JOIN iv ON x.cov = c1 AND x.cov2 = c2 GROUP BY x.cov)),
    {inverse_sql("gs", "sm", "si")}"""

ORACLES = {
    "y_matrix_long": on(E, f"SELECT site, species, {r('y')} AS y, y IS NOT NULL AS observed FROM y"),
    "design_matrix": on(B, f"SELECT site, cov, {r('x')} AS x FROM x"),
    "trait_matrix": on(B, f"SELECT species, trait, {r('t')} AS t FROM tr"),
    "linear_predictor": on(E, f"SELECT site, species, {r('l')} AS l FROM l"),
    "z_augment_stats": on(PG, f"""SELECT site, species, {r("CASE WHEN y IS NOT NULL THEN 1 / (sigma * sigma) ELSE 0 END", 5)} AS id,
        CASE WHEN family = 2 THEN CASE WHEN y > 0 THEN 0.0 ELSE -1000.0 END END::DOUBLE AS low, CASE WHEN family = 2 THEN CASE WHEN y = 0 THEN 0.0 ELSE 1000.0 END END::DOUBLE AS high,
        {r("CASE WHEN family = 3 AND y IS NOT NULL THEN m END", 5)} AS pg_mean, {r("CASE WHEN family = 3 AND y IS NOT NULL THEN sd END", 5)} AS pg_sd,
        {r("CASE WHEN family = 3 AND y IS NOT NULL THEN (1 / (1 / (sigma * sigma) + m)) * ((y - 1000) / 2 + m * ln(1000.0::DOUBLE) + l / (sigma * sigma)) END", 5)} AS mu,
        {r("CASE WHEN family = 3 AND y IS NOT NULL THEN 1 / (1 / (sigma * sigma) + m) END", 5)} AS s2 FROM pgm"""),
    "sigma_gamma_params": on(E, f"SELECT species, {r('1 + count(y) / 2', 4)} AS shape, {r('5 + coalesce(sum((y - l) * (y - l)), 0) / 2', 4)} AS rate FROM cells GROUP BY species"),
    "beta_normal_equations": on(B, f"""SELECT species, a.cov AS a, b.cov AS b, {r('sum(id * a.x * b.x)', 3)} AS v FROM cells JOIN x a USING (site) JOIN x b USING (site) GROUP BY ALL
        UNION ALL SELECT species, cov, -1, {r('sum(id * x * coalesce(z, 0))', 3)} FROM cells JOIN x USING (site) GROUP BY ALL"""),
    "gamma_v_scatter": on(B, f"""SELECT 'A' AS part, a.cov AS i, b.cov AS j, {r('sum(a.v * b.v)')} AS v FROM resid a JOIN resid b USING (species) GROUP BY ALL
        UNION ALL SELECT 'TT', a.trait, b.trait, {r('sum(a.t * b.t)')} FROM tr a JOIN tr b USING (species) GROUP BY ALL
        UNION ALL SELECT 'BT', cov, trait, {r('sum(v * t)')} FROM beta JOIN tr USING (species) GROUP BY ALL"""),
    "eta_scatter": on(f"""{B},
        fx AS (SELECT site, species, sum(x * v) AS f FROM x JOIN beta USING (cov) GROUP BY ALL),
        rn AS (SELECT level, site, lam.species, sum(eta.v * lam.v) AS r FROM pi JOIN eta USING (level, unit) JOIN lam USING (level, h) GROUP BY ALL),
        s AS (SELECT c.site, c.species, id, level, unit, z - f - (SELECT sum(r) FROM rn o WHERE o.site = c.site AND o.species = c.species AND o.level <> pi.level) AS s
              FROM cells c JOIN fx USING (site, species) JOIN pi USING (site))""",
        f"""SELECT level, unit, h, -1 AS k, {r('sum(id * coalesce(s, 0) * v)', 4)} AS v FROM s JOIN lam USING (level, species) GROUP BY ALL
        UNION ALL SELECT level, unit, a.h, b.h, {r('sum(id * a.v * b.v)', 4)} FROM s JOIN lam a USING (level, species) JOIN lam b USING (level, species) GROUP BY ALL"""),
    "eta_scatter_by_unit_covariates": on(f"""{B},
        ul AS (SELECT level, unit, h, species, sum(v * (c + 1) * CASE WHEN c = 0 THEN 1.0 ELSE unit / 10.0::DOUBLE END) AS v FROM (SELECT DISTINCT level, unit FROM pi) JOIN lam USING (level), (SELECT unnest([0, 1]) AS c) GROUP BY ALL),
        fx AS (SELECT site, species, sum(x * v) AS f FROM x JOIN beta USING (cov) GROUP BY ALL),
        rn AS (SELECT level, site, species, sum(eta.v * ul.v) AS r FROM pi JOIN eta USING (level, unit) JOIN ul USING (level, unit, h) GROUP BY ALL),
        s AS (SELECT c.site, c.species, id, level, unit, z - f - (SELECT sum(r) FROM rn o WHERE o.site = c.site AND o.species = c.species AND o.level <> pi.level) AS s
              FROM cells c JOIN fx USING (site, species) JOIN pi USING (site))""",
        f"""SELECT level, unit, h, -1 AS k, {r('sum(id * coalesce(s, 0) * v)', 4)} AS v FROM s JOIN ul USING (level, unit, species) GROUP BY ALL
        UNION ALL SELECT level, unit, a.h, b.h, {r('sum(id * a.v * b.v)', 4)} FROM s JOIN ul a USING (level, unit, species) JOIN ul b USING (level, unit, species) GROUP BY ALL"""),
    "eta_common_flag": on(B, """SELECT level, bool_and(hi - lo <= 1e-9 * hi) AS common FROM (SELECT level, species, max(id) AS hi, min(id) AS lo FROM
        (SELECT level, unit, species, sum(id) AS id FROM cells JOIN pi USING (site) GROUP BY ALL) GROUP BY ALL) GROUP BY level"""),
    "loading_prior_precision": on(B, f"SELECT level, h, species, {r('v * tau')} AS prec FROM psi JOIN tau USING (level, h)"),
    "shrinkage_local_params": on(f"{B}, {SHR}", f"SELECT level, h, species, {r('3.0::DOUBLE / 2 + 0.5')} AS a_psi, {r('3.0::DOUBLE / 2 + lv * lv * tau / 2')} AS b_psi FROM cell"),
    "shrinkage_global_params": on(f"{B}, {SHR}, m AS (SELECT level, h, delta, tau, sum(psi * lv * lv) AS m, count(*) AS n FROM cell GROUP BY ALL)",
        f"""SELECT level, h, {r('tau')} AS tau, {r('m')} AS m, {r('50 + n * count(*) OVER w / 2')} AS ad, {r('1 + sum(tau * m) OVER w / delta / 2')} AS bd FROM m
        WINDOW w AS (PARTITION BY level ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    "nf_redundancy": on(f"""{B}, s AS (SELECT level, h, avg((abs(CASE WHEN level = 1 AND h = 2 THEN 0 ELSE v END) < 0.001)::INT::DOUBLE) AS share FROM lam GROUP BY ALL)""",
        f"""SELECT level, h, {r('share')} AS share, share >= 1 AS redundant, CASE WHEN max(share) OVER w < 0.995 AND count(*) OVER w < 5 OR count(*) OVER w < 2 THEN 'add'
        WHEN count(*) OVER w > 2 AND max(share) OVER w >= 1 THEN 'drop' ELSE 'keep' END AS action FROM s WINDOW w AS (PARTITION BY level)"""),
    "nf_reindex": on(B, """SELECT level, CASE WHEN level = 0 AND h = 2 THEN 1 ELSE h END::INT AS h, species, v FROM lam WHERE NOT (level = 0 AND h = 1) UNION ALL SELECT DISTINCT level, 3, species, 0.0::DOUBLE FROM lam"""),
    "selection_mask": on(B, "SELECT cov, species, mask FROM mask"),
    "effective_design": on(B, f"SELECT species, cov, {r('sum(x * mask)', 4)} AS x FROM x JOIN mask USING (cov) GROUP BY ALL"),
    "selection_loglik": on(f"""{B},
        ms AS (SELECT s.sel, b.cov, b.species, coalesce(min(a.active::INT), 1) AS mask FROM (SELECT DISTINCT cov, species FROM beta) b CROSS JOIN (SELECT unnest([0, 1]) AS sel) s
               LEFT JOIN scov ON scov.cov = b.cov AND scov.sel <> s.sel LEFT JOIN ssp ON ssp.sel = scov.sel AND ssp.species = b.species LEFT JOIN sact a ON a.sel = ssp.sel AND a.grp = ssp.grp GROUP BY ALL),
        f AS (SELECT ms.sel, site, ms.species, sum(x * v * mask * CASE WHEN scov.cov IS NULL THEN 1 ELSE 0 END) AS off, sum(x * v * mask) AS onn
              FROM x JOIN beta USING (cov) JOIN ms ON ms.cov = x.cov AND ms.species = beta.species LEFT JOIN scov ON scov.sel = ms.sel AND scov.cov = ms.cov GROUP BY ALL),
        ll AS (SELECT sel, grp, sum(-0.5 * id * (z - off) * (z - off)) + ln(1 - max(q)) AS ll0, sum(-0.5 * id * (z - onn) * (z - onn)) + ln(max(q)) AS ll1
               FROM f JOIN cells USING (site, species) JOIN ssp USING (sel, species) JOIN sact USING (sel, grp) WHERE id > 0 GROUP BY ALL)""",
        f"SELECT sel, grp::INT AS grp, {r('ll0', 3)} AS ll0, {r('ll1', 3)} AS ll1, {r('1 / (1 + exp(least(ll0 - ll1, 700.0::DOUBLE)))', 3)} AS p1 FROM ll"),
    "rrr_normal_equations": on(f"""{B}, b AS (SELECT cov - 4 AS h, species, v FROM beta WHERE cov IN (4, 5)),
        inn AS (SELECT site, a.h AS h, c.h AS g, sum(id * a.v * c.v) AS v FROM cells JOIN b a USING (species) JOIN b c USING (species) GROUP BY ALL),
        pull AS (SELECT site, h, sum(id * coalesce(z, 0) * v) AS v FROM cells JOIN b USING (species) GROUP BY ALL)""",
        f"""SELECT h, a.k, g, c.k AS l, {r('sum(v * a.x * c.x)', 4)} AS v FROM inn JOIN xr a USING (site) JOIN xr c USING (site) GROUP BY ALL
        UNION ALL SELECT h, k, -1, -1, {r('sum(v * x)', 4)} FROM pull JOIN xr USING (site) GROUP BY ALL"""),
    "rrr_design": on(B, f"SELECT site, h AS cov, {r('sum(x * ((h + 1) * 0.5 - k * 0.25)::DOUBLE)')} AS x FROM xr, (SELECT unnest([0, 1]) AS h) GROUP BY ALL"),
    "gp_covariance_grid": on(G, f"SELECT g, i, {r('sum(w)', 4)} AS w FROM (SELECT g, a.i AS i, {W} AS w FROM u a, u b, grid) GROUP BY ALL"),
    "gpp_cross_covariance": on(G, f"SELECT g, a.i AS i, b.j AS j, {r(W)} AS w FROM u a, kn b, grid"),
    "gpp_knot_covariance": on(G, f"SELECT g, a.j AS i, b.j AS j, {r(W)} AS w FROM kn a, kn b, grid"),
    "knn_neighbours": on(f"{G}, {KNN}", f"SELECT i, j, rank::INT AS rank, {r('d')} AS d FROM nn WHERE rank <= 5"),
    "nngp_loglik_1nn": on(f"""{G}, {KNN},
        a AS (SELECT g, pw, u.i, nn.j, CASE WHEN nn.j IS NULL THEN 0.0 WHEN alpha = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-d / alpha) END AS a FROM u LEFT JOIN nn ON nn.i = u.i AND rank = 1 CROSS JOIN grid),
        e AS (SELECT g, h, pw, greatest(1 - a * a, 1e-9) AS var, o.v - a * coalesce(p.v, 0) AS e FROM a JOIN eta o ON o.unit = a.i LEFT JOIN eta p ON p.unit = a.j AND p.h = o.h)""".replace("SELECT g, h, pw", "SELECT g, o.h AS h, pw"),
        f"SELECT g, h, {r('ln(pw) - sum(ln(var) + e * e / var) / 2', 3)} AS ll FROM e GROUP BY g, h, pw"),
    "alpha_loglik_grid": on(f"""{G}, un AS (SELECT j AS unit FROM kn), n AS (SELECT count(*)::DOUBLE AS n FROM un),
        e AS (SELECT unit, h, ((unit * 3 + h * 2) % 7 - 3) / 2.0::DOUBLE AS v FROM un, (SELECT unnest([0, 1]) AS h)),
        s AS (SELECT h, sum(v * v) AS ss, sum(v) AS s FROM e GROUP BY h),
        ll AS (SELECT h, g, ln(pw) - ((n - 1) * ln(1 - c) + ln(1 + (n - 1) * c)) / 2 - (ss - c / (1 + (n - 1) * c) * s * s) / (1 - c) / 2 AS ll FROM s, n, (SELECT *, alpha / (1 + alpha) AS c FROM grid))""",
        f"SELECT h, g, {r('ll')} AS ll, {r('exp(ll - max(ll) OVER w) / sum(exp(ll)) OVER w * exp(max(ll) OVER w)')} AS p FROM ll WINDOW w AS (PARTITION BY h)"),
    "rho_loglik_grid": on(f"""{B}, q AS (SELECT a.species AS j, sum(a.v * iv.v * b.v) AS quad, count(DISTINCT c1) AS nc FROM resid a JOIN iv ON a.cov = c1 JOIN resid b ON b.cov = c2 AND b.species = a.species GROUP BY ALL),
        gr AS (SELECT g::INT AS g, g / 10.0::DOUBLE AS rho, CASE WHEN g = 0 THEN 0.5 ELSE 0.05 END::DOUBLE AS pw FROM (SELECT unnest(range(11)) AS g)),
        ll AS (SELECT g, ln(pw) - sum(nc * ln(rho * (j + 1) / 13.0::DOUBLE + 1 - rho) + quad / (rho * (j + 1) / 13.0::DOUBLE + 1 - rho)) / 2 AS ll FROM q, gr GROUP BY g, pw)""",
        f"SELECT g, {r('ll', 4)} AS ll, {r('exp(ll - max(ll) OVER ()) / (SELECT sum(exp(ll - (SELECT max(ll) FROM ll))) FROM ll)', 4)} AS p FROM ll"),
    "taxonomic_similarity": on(B, f"SELECT a.species AS sp1, b.species AS sp2, {r('avg((a.taxon = b.taxon)::INT::DOUBLE)')} AS c FROM tax a JOIN tax b USING (rank) GROUP BY ALL"),
    "draw_schedule": "SELECT event_id AS iteration, ((event_id - 49) // 8 - 1)::INT AS draw FROM events WHERE event_id >= 50 AND (event_id - 49) % 8 = 0",
    "partition_cumcounts": "SELECT part, n, sum(n) OVER (ORDER BY part)::BIGINT AS cum FROM (SELECT (c_custkey % 8 + 1)::INT AS part, count(*) AS n FROM customer GROUP BY 1)",
    "partition_rows": "SELECT c_custkey AS site, (c_custkey % 8 + 1)::INT AS part FROM customer WHERE c_custkey % 8 + 1 BETWEEN 1 AND 3",
    "normalised_times": f"""WITH n AS (SELECT event_type, sum(value) / count(*) AS p FROM events GROUP BY 1)
        SELECT event_type, {r('p', 4)} AS per_iteration, {r('log10(p / first_value(p) OVER (ORDER BY event_type))', 4)} AS log_ratio, {r('p * 100000', 4)} AS extrapolated FROM n""",
    "predictor_by_unit_covariates": on(E, f"""SELECT level, lam.species, {r("sum(eta.v * lam.v * (k + 1) * CASE WHEN k = 0 THEN 1.0 ELSE unit / 10.0::DOUBLE END)", 4)} AS v
        FROM pi JOIN eta USING (level, unit) JOIN lam USING (level, h), (SELECT unnest([0, 1]) AS k) GROUP BY ALL"""),
    "posterior_summary": f"WITH {DRAWS} SELECT param, count(*) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('quantile_cont(v, 0.025)')} AS q025, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.975)')} AS q975 FROM d GROUP BY param",
    "posterior_r_hat": f"""WITH {DRAWS}, c AS (SELECT param, chain, avg(v) AS m, var_samp(v) AS s2, count(*) AS n FROM d GROUP BY ALL)
        SELECT param, {r('sqrt((avg(n) - 1) / avg(n) + var_samp(m) / avg(s2))')} AS r_hat FROM c GROUP BY param""",
    "posterior_ess": f"""WITH {DRAWS}, e AS (SELECT *, v - avg(v) OVER (PARTITION BY param, chain) AS e FROM d), f AS (SELECT *, lag(e) OVER (PARTITION BY param, chain ORDER BY draw) AS b FROM e)
        SELECT param, count(*) AS n, {r('count(*) * (1 - sum(e * b) / sum(e * e)) / (1 + sum(e * b) / sum(e * e))', 4)} AS ess FROM f GROUP BY param""",
    "model_file_responses": on(f"{E}, {PLACE}", f"SELECT place AS site, espec.species::INT AS species, {r('y')} AS y FROM st CROSS JOIN espec LEFT JOIN y ON y.site = st.site AND y.species = espec.species"),
    "model_file_design": on(f"{E}, {PLACE}", f"SELECT place AS site, cov::INT AS cov, {r('x')} AS x FROM x JOIN st USING (site)"),
    "model_file_dims": on(E, "SELECT (SELECT count(DISTINCT site) FROM x)::INT AS ny, (SELECT count(*) FROM esp)::INT AS ns, 2::INT AS nc, 2::INT AS nr"),
    "draws_json_round_trip": on(MODEL_DRAWS, f"SELECT chain::INT AS chain, draw::INT AS draw, param, level::INT AS level, i::INT AS i, j::INT AS j, {r('v')} AS v FROM ds"),
    "covariate_loadings_json_round_trip": on(E, f"""SELECT (d % 2)::INT AS chain, d::INT AS draw, 'Lambda' AS param, level::INT AS level, h::INT AS i, species::INT AS j, CASE WHEN level = 1 THEN c END::INT AS k, {r('v * (c + 1) + d')} AS v
        FROM lam, (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1, 2, 3, 4]) AS d) WHERE level = 1 OR c = 0"""),
    "model_parts_cells": on(B, f"""SELECT 'y' AS part, site::BIGINT AS i, species::INT AS j, {r('CASE WHEN (site + species) % 7 <> 0 THEN y END')} AS v FROM y
        UNION ALL SELECT 'x', site, cov::INT, {r('x')} FROM x UNION ALL SELECT 'traits', species::BIGINT, trait::INT, {r('t')} FROM tr UNION ALL SELECT 'pi', site, level::INT, {r('unit')} FROM pi"""),
    "model_parts_dims": on(E, "SELECT (SELECT count(DISTINCT site) FROM x) AS ny, (SELECT count(*) FROM espec)::INT AS ns, 2::INT AS nc, 0::INT AS nt, 2::INT AS nr"),
    "model_parts_levels": on(B, """SELECT level::INT AS level, 3.0::DOUBLE AS nu, 50.0::DOUBLE AS a1, 1.0::DOUBLE AS b1, 50.0::DOUBLE AS a2, 1.0::DOUBLE AS b2, 2::INT AS nf_min, count(DISTINCT unit)::INT AS nf_max,
        CASE WHEN level = 0 THEN 2 ELSE 0 END::INT AS s_dim, CASE WHEN level = 1 THEN 2 ELSE 0 END::INT AS x_dim, CASE WHEN level = 0 THEN 'NNGP' END AS method FROM pi GROUP BY level"""),
    "model_parts_state": on(f"""{B}, ps AS (SELECT 'Beta' AS param, -1 AS level, cov AS i, species AS j, NULL AS k, v FROM beta
        UNION ALL SELECT 'Eta', level, unit, h, NULL, v FROM eta
        UNION ALL SELECT 'Lambda', level, h, species, CASE WHEN level = 1 THEN c END, v * (c + 1) FROM lam, (SELECT unnest([0, 1]) AS c) WHERE level = 1 OR c = 0
        UNION ALL SELECT DISTINCT 'Alpha', level, h, 0, NULL, h * 2.0::DOUBLE FROM lam)""",
        f"SELECT chain::INT AS chain, param, level::INT AS level, i::INT AS i, j::INT AS j, k::INT AS k, {r('v + chain')} AS v FROM ps, (SELECT unnest([0, 1]) AS chain)"),
    "draws_summary": on(MODEL_DRAWS, f"SELECT param, level::INT AS level, i::INT AS i, j::INT AS j, count(*) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('quantile_cont(v, 0.5)')} AS median FROM ds GROUP BY param, level, i, j"),
    "nngp_weights_two": on(TWO, f"""SELECT g, i, i AS j, {r('s', 5)} AS v FROM s UNION ALL SELECT g, i, j1, {r('-w1 * s', 5)} FROM s WHERE j1 IS NOT NULL UNION ALL SELECT g, i, j2, {r('-w2 * s', 5)} FROM s WHERE j2 IS NOT NULL
        UNION ALL SELECT g, i, i, 1.0::DOUBLE FROM u, grid WHERE alpha = 0"""),
    "gpp_knot_identity": on(G, "SELECT g, a.j::BIGINT AS i, b.j::BIGINT AS k, (a.j = b.j)::INT::DOUBLE AS v FROM kn a, kn b, grid"),
    "rrr_prior_params": on(f"""{B}, dl AS (SELECT trait AS h, 1 + trait * 0.5::DOUBLE AS delta FROM (SELECT DISTINCT trait FROM tr)), tu AS (SELECT h, delta, product(delta) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS tau FROM dl),
        c AS (SELECT h, species, t, (1 + (h + species) % 3 * 0.5)::DOUBLE AS psi, delta, tau FROM tr JOIN tu ON h = trait),
        m AS (SELECT h, delta, tau, sum(psi * t * t) AS m, count(*) AS n FROM c GROUP BY ALL)""",
        f"""SELECT h, species, {r('2.0::DOUBLE', 5)} AS a, {r('1.5 + t * t * tau / 2', 5)} AS b FROM c
        UNION ALL SELECT h, -1, {r('CASE WHEN h = 0 THEN 1 ELSE 50 END + n * count(*) OVER w / 2', 5)}, {r('1 + sum(tau * m) OVER w / delta / 2', 5)} FROM m WINDOW w AS (ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    "event_draws_summary": f"WITH {EVENT_DRAWS} SELECT param, i, count(*) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('quantile_cont(v, 0.025)')} AS q025, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.975)')} AS q975 FROM d GROUP BY param, i",
    "event_draws_r_hat": f"""WITH {EVENT_DRAWS}, c AS (SELECT param, i, chain, avg(v) AS m, var_samp(v) AS s2, count(*) AS n FROM d GROUP BY ALL)
        SELECT param, i, {r('CASE WHEN avg(s2) > 0 THEN sqrt((avg(n) - 1) / avg(n) + var_samp(m) / avg(s2)) END')} AS r_hat FROM c GROUP BY param, i""",
    "event_draws_ess": f"""WITH {EVENT_DRAWS}, e AS (SELECT *, v - avg(v) OVER (PARTITION BY param, i, chain) AS e FROM d),
        c AS (SELECT param, i, (b.draw - a.draw) // 2 AS k, sum(a.e * b.e) AS c, coalesce(sum(a.e * b.e) FILTER (a.draw = b.draw), 0) AS c0, count(*) FILTER (a.draw = b.draw) AS n
              FROM e a JOIN e b USING (param, i, chain) WHERE b.draw >= a.draw GROUP BY ALL),
        p AS (SELECT param, i, k, c, max(c0) OVER w AS c0, sum(n) OVER w AS n FROM c WINDOW w AS (PARTITION BY param, i)),
        f AS (SELECT *, max((c <= 0)::INT) OVER (PARTITION BY param, i ORDER BY k) AS off FROM p),
        t AS (SELECT param, i, max(n)::BIGINT AS n, max(c0) AS c0, coalesce(sum(c) FILTER (off = 0), 0) AS s FROM f GROUP BY ALL)
        SELECT param, i, n, {r('n / CASE WHEN c0 > 0 THEN greatest(2 * s / c0 - 1, 1 / greatest(log10(n), 1.0::DOUBLE)) ELSE 1 END', 4)} AS ess FROM t""",
    "csv_responses": on(E, f"SELECT s.site, 'sp' || espec.species AS species, {r('y')} AS y FROM (SELECT DISTINCT site FROM y) s CROSS JOIN espec LEFT JOIN y ON y.site = s.site AND y.species = espec.species"),
    "log_density_terms": on(f"""{B},
        fx AS (SELECT site, species, sum(x * v) AS f FROM x JOIN beta USING (cov) GROUP BY ALL),
        rn AS (SELECT site, lam.species, sum(eta.v * lam.v) AS r FROM pi JOIN eta USING (level, unit) JOIN lam USING (level, h) GROUP BY ALL)""",
        f"""SELECT 'responses' AS term, {r('-0.5 * sum(id * (z - f - r) * (z - f - r))', 3)} AS v FROM cells JOIN fx USING (site, species) JOIN rn USING (site, species)
        UNION ALL SELECT 'coefficients', {r('-0.5 * sum(a.v * iv.v * b.v)', 3)} FROM resid a JOIN iv ON a.cov = c1 JOIN resid b ON b.cov = c2 AND b.species = a.species
        UNION ALL SELECT 'scores', {r('-0.5 * sum(v * v)', 3)} FROM (SELECT ((unit * 7 + h * 3 + level * 5) % 11 - 5) / 5.0::DOUBLE AS v FROM (SELECT 0 AS level, n_nationkey AS unit FROM nation UNION SELECT 1, n_regionkey FROM nation), (SELECT unnest([0, 1, 2]) AS h))
        UNION ALL SELECT 'loadings', {r('-0.5 * sum(psi.v * tau * lam.v * lam.v)', 3)} FROM lam JOIN psi USING (level, h, species) JOIN tau USING (level, h)"""),
    "z_draws": on(f"""{PG},
        dr AS (SELECT *, {quantile_sql("u0")} AS n0, {quantile_sql("u1")} AS n1, CASE WHEN y > 0 THEN 1 ELSE -1 END AS side FROM {CELL_DRAWS}),
        o AS (SELECT *, abs(m + sd * n0) AS w, -side * l / sigma AS cut FROM dr),
        b AS (SELECT *, 1 / (1 / (sigma * sigma) + w) AS var, CASE WHEN cut > 0 THEN {tail_sql("abs(cut)")} * CASE WHEN side > 0 THEN u0 ELSE u0 END ELSE NULL END AS beyond,
                     CASE WHEN cut <= 0 THEN {tail_sql("abs(cut)")} END AS short FROM o),
        q AS (SELECT *, CASE WHEN cut > 0 THEN CASE WHEN side > 0 THEN beyond ELSE beyond END WHEN side > 0 THEN short + u0 * (1 - short) ELSE u0 * (1 - short) END AS p FROM b)""",
        f"""SELECT site, species, {r(f"""CASE WHEN y IS NULL THEN CASE WHEN family = 3 THEN 0 ELSE l + sigma * n0 END WHEN family = 1 THEN y
            WHEN family = 2 THEN l + sigma * CASE WHEN side > 0 AND cut > 0 THEN -1 ELSE 1 END * {quantile_sql("p")}
            ELSE var * ((y - 1000) / 2 + w * ln(1000.0::DOUBLE) + l / (sigma * sigma)) + sqrt(var) * n1 END""", 5)} AS z FROM q"""),
    "alpha_draws": on(f"""{G}, {KNN},
        a AS (SELECT g, pw, u.i, nn.j, CASE WHEN nn.j IS NULL THEN 0.0 WHEN alpha = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-d / alpha) END AS a FROM u LEFT JOIN nn ON nn.i = u.i AND rank = 1 CROSS JOIN grid),
        e AS (SELECT g, o.h AS h, pw, greatest(1 - a * a, 1e-9) AS var, o.v - a * coalesce(p.v, 0) AS e FROM a JOIN eta o ON o.unit = a.i LEFT JOIN eta p ON p.unit = a.j AND p.h = o.h),
        ll AS (SELECT g, h, (ln(pw) - sum(ln(var) + e * e / var) / 2) * (20.0::DOUBLE / (SELECT count(*) FROM u)) AS ll FROM e GROUP BY g, h, pw),
        it AS (SELECT * FROM ll, (SELECT unnest([0, 1]) AS chain), (SELECT unnest(range(200)) AS iteration))""",
        f"""SELECT chain::INT AS chain, iteration::INT AS iteration, h, arg_max(g, ll - ln(-ln(u))) AS g FROM {uniform_sql("it", SEED, "chain", "iteration", "h * 64 + g", "u")} GROUP BY chain, iteration, h"""),
    "beta_lambda_mean": on(JOINT, f"SELECT species, a::INT AS a, {r('sum(v) * sqrt(2.0::DOUBLE)', 4)} AS v FROM rhs GROUP BY species, a"),
    "beta_lambda_draws": on(f"{B}, k AS (SELECT species, unnest(range(12)) AS k FROM spec)", f"SELECT species, {r(f'sum({quantile_sql("u")} * {quantile_sql("u")})', 4)} AS v FROM {uniform_sql('k', SEED, str(CHAIN), str(ITERATION), 'species * 12 + k', 'u')} GROUP BY species"),
    "gpp_variances": f"WITH RECURSIVE {KNOTS} SELECT g, i, {r('dd', 5)} AS dd FROM dd",
    "gpp_information": f"WITH RECURSIVE {KNOTS}, nm AS (SELECT j, row_number() OVER (ORDER BY j) AS k FROM kn) SELECT g, a.j::BIGINT AS k, b.j::BIGINT AS l, {r('v / 100', 4)} AS v FROM fm JOIN nm a USING (k) JOIN nm b ON b.k = fm.l",
    "gpp_loglik": f"""WITH RECURSIVE {KNOTS},
        ff AS (SELECT g, list(r ORDER BY k) AS a FROM (SELECT g, k, list(v ORDER BY l) AS r FROM fm GROUP BY g, k) GROUP BY g),
        {inverse_sql("gf", "ff", "fi")},
        s AS (SELECT g, h, list(v ORDER BY k) AS s FROM (SELECT g, h, k, sum(wk * v / dd) AS v FROM sc JOIN eta ON unit = i GROUP BY ALL) GROUP BY g, h),
        q AS (SELECT g, h, sum(v * v / dd) AS q FROM dd JOIN eta ON unit = i GROUP BY g, h),
        dt AS (SELECT g, sum(ln(dd)) AS d FROM dd GROUP BY g),
        o AS (SELECT g, h, pw, d - i22.ld + fi.ld AS log_det, q - list_dot_product(s, list_transform(fi.a, lambda row: list_dot_product(row, s))) AS quad FROM s JOIN q USING (g, h) JOIN dt USING (g) JOIN i22 USING (g) JOIN fi USING (g) JOIN grid USING (g))
        SELECT g, h, {r('log_det', 3)} AS log_det, {r('quad', 3)} AS quad, {r('ln(pw) - log_det / 2 - quad / 2', 3)} AS ll FROM o""",
    "gpp_knot_inverse": f"""WITH RECURSIVE {KNOTS}, nm AS (SELECT j, row_number() OVER (ORDER BY j) AS k FROM kn)
        SELECT g, x.j::BIGINT AS i, y.j::BIGINT AS j, {r('a[x.k][y.k]')} AS w, {r('ld')} AS log_det FROM i22, nm x, nm y""",
    "nngp_loglik_two": on(TWO, f"""SELECT g, h, {r('log_det', 3)} AS log_det, {r('quad', 3)} AS quad, {r('ln(pw) - log_det / 2 - quad / 2', 3)} AS ll
        FROM (SELECT g, o.h AS h, -2 * sum(ln(s)) AS log_det, sum(s * s * (o.v - coalesce(w1 * a.v, 0) - coalesce(w2 * b.v, 0)) * (o.v - coalesce(w1 * a.v, 0) - coalesce(w2 * b.v, 0))) AS quad
              FROM (SELECT g, i, j1, j2, w1, w2, s FROM s UNION ALL SELECT g, i, NULL, NULL, NULL, NULL, 1.0 FROM u, grid WHERE alpha = 0) x
              JOIN eta o ON o.unit = x.i LEFT JOIN eta a ON a.unit = j1 AND a.h = o.h LEFT JOIN eta b ON b.unit = j2 AND b.h = o.h GROUP BY g, o.h) JOIN grid USING (g)"""),
    "gp_solution": on(G, f"SELECT g, unit AS i, h, {r('v', 4)} AS v FROM eta, grid"),
    "nngp_scores": f"""SELECT vec_id AS unit, h, {r("sum(4 * embedding[5 + s]::DOUBLE * ((s * 5 + h * 3) % 7 - 3) / 4.0::DOUBLE)", 4)} AS v
        FROM embeddings, (SELECT unnest([0, 1]) AS h), (SELECT unnest(range(8)) AS s) GROUP BY vec_id, h""",
    "delta_draws": f"""WITH RECURSIVE {B}, {SHR},
        m AS (SELECT level, h, delta, tau, sum(psi * lv * lv) AS m, count(*) AS n FROM cell GROUP BY ALL),
        o AS (SELECT level, h, (50 + n * (count(*) OVER w) / 2) * (0.8::DOUBLE + h * 0.3::DOUBLE) AS g, sum(tau * m) OVER w / tau AS rest FROM m WINDOW w AS (PARTITION BY level ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        f(level, h, upto, v) AS (SELECT level, h, g / (1 + rest / 2), g / (1 + rest / 2) FROM o WHERE h = 0
            UNION ALL SELECT o.level, o.h, f.upto * o.g / (1 + f.upto * o.rest / 2), o.g / (1 + f.upto * o.rest / 2) FROM f JOIN o ON o.level = f.level AND o.h = f.h + 1)
        SELECT level, h, {r('v')} AS v FROM f""",
    "gamma_mean": on(f"{B}, bt AS (SELECT cov, trait, sum(v * t) AS v FROM beta JOIN tr USING (species) GROUP BY ALL)",
        f"SELECT (trait * 6 + c1)::INT AS a, {r('(sum(iv.v * bt.v) + 0.1::DOUBLE) * sqrt(2.0::DOUBLE)', 4)} AS v FROM iv JOIN bt ON cov = c2 GROUP BY trait, c1"),
    "gamma_draws": f"WITH k AS (SELECT unnest(range(18)) AS k) SELECT 0 AS model, {r(f'sum({quantile_sql("u")} * {quantile_sql("u")})', 4)} AS v FROM {uniform_sql('k', SEED, str(CHAIN), str(ITERATION), 'k', 'u')}",
    "iv_draws": f"""WITH RECURSIVE {B}, {CHI}
        SELECT 'trace' AS term, {r('(SELECT sum(v) FROM ch) + lv.v', 5)} AS v FROM lv UNION ALL SELECT 'log_det', {r('(SELECT sum(ln(v)) FROM ch) - ld', 5)} FROM si""",
    "similarity_rebuilt": on(B, f"SELECT a.species::BIGINT AS sp1, b.species::BIGINT AS sp2, {r('avg((a.taxon = b.taxon)::INT::DOUBLE)')} AS c FROM tax a JOIN tax b USING (rank) GROUP BY ALL"),
    "rho_loglik_rotated": f"""WITH RECURSIVE {ALIKE},
        rs AS (SELECT cov, list(v ORDER BY species) AS x FROM resid GROUP BY cov),
        qd AS (SELECT g, sum(iv.v * list_dot_product(p.x, list_transform(qi.a, lambda row: list_dot_product(row, q.x)))) AS quad FROM qi, iv JOIN rs p ON p.cov = c1 JOIN rs q ON q.cov = c2 GROUP BY g),
        ll AS (SELECT g, ln(pw) - 6 * ld / 2 - quad / 2 AS ll FROM qd JOIN qi USING (g) JOIN gr USING (g))
        SELECT g, {r('ll', 4)} AS ll, {r('exp(ll - (SELECT max(ll) FROM ll)) / (SELECT sum(exp(ll - (SELECT max(ll) FROM ll))) FROM ll)', 4)} AS p FROM ll""",
    "gamma_mean_phylogeny": f"""WITH RECURSIVE {ALIKE},
        bl AS (SELECT cov, list(v ORDER BY species) AS x FROM beta GROUP BY cov),
        tl AS (SELECT trait, list(t ORDER BY species) AS t FROM tr GROUP BY trait),
        bt AS (SELECT cov, trait, list_dot_product(x, list_transform(qi.a, lambda row: list_dot_product(row, t))) AS v FROM qi, bl, tl WHERE g = 6)
        SELECT (trait * 6 + c1)::INT AS a, {r('(sum(iv.v * bt.v) + 0.1::DOUBLE) * sqrt(2.0::DOUBLE)', 4)} AS v FROM iv JOIN bt ON cov = c2 GROUP BY trait, c1""",
    "integrated_density": f"""SELECT 'loadings' AS term, {r('v', 3)} AS v FROM (WITH {B} SELECT sum(0.5::DOUBLE * ln(tau) - 2 * ln(1 + tau * v * v / 3)) AS v FROM lam JOIN tau USING (level, h))
        UNION ALL SELECT 'scores', {r('v', 3)} FROM (WITH {G}, {KNN},
            a AS (SELECT g, pw, u.i, nn.j, CASE WHEN nn.j IS NULL THEN 0.0 WHEN alpha = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-d / alpha) END AS a FROM u LEFT JOIN nn ON nn.i = u.i AND rank = 1 CROSS JOIN grid),
            e AS (SELECT g, o.h AS h, pw, greatest(1 - a * a, 1e-9) AS var, o.v - a * coalesce(p.v, 0) AS e FROM a JOIN eta o ON o.unit = a.i LEFT JOIN eta p ON p.unit = a.j AND p.h = o.h),
            ll AS (SELECT g, h, ln(pw) - sum(ln(var) + e * e / var) / 2 AS ll FROM e GROUP BY g, h, pw),
            tp AS (SELECT h, max(ll) AS top FROM ll GROUP BY h)
            SELECT sum(x) AS v FROM (SELECT top + ln(sum(exp(ll - top))) AS x FROM ll JOIN tp USING (h) GROUP BY h, top))""",
}
