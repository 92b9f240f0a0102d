"""What each conditional draw needs to know of the data: sums, rates, normal equations, log-likelihood tables."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import draws
from quadrat.functions.scalar import polya_gamma
from quadrat.functions.tensor import as_map, contract, cumulative_product, dot, gram, softmax, suffix_sum, widen, with_lists
from quadrat.operators.design import by_site, total
from quadrat.operators.solve import equations

NB_R = 1000.0


def augmentation(cells: DataFrame) -> DataFrame:
    """cells(site, species, family, y, l, sigma): precision, bounds, Polya-Gamma moments, conditional moments of counts."""
    seen, y = F.col("y").isNotNull(), F.coalesce("y", F.lit(0.0))
    var = F.col("sigma") * F.col("sigma")
    probit, count = F.col("family") == 2, (F.col("family") == 3) & F.col("y").isNotNull()
    m, s = polya_gamma(y + NB_R, F.col("l") - log(NB_R))
    s2 = 1 / (1 / var + m)
    mu = s2 * ((y - NB_R) / 2 + m * log(NB_R) + F.col("l") / var)
    return cells.select(
        "site", "species",
        F.when(seen, 1 / var).otherwise(0.0).alias("id"),
        F.when(probit, F.when(seen & (y > 0), 0.0).otherwise(-1000.0)).alias("low"),
        F.when(probit, F.when(seen & (y == 0), 0.0).otherwise(1000.0)).alias("high"),
        F.when(count, m).alias("pg_mean"), F.when(count, s).alias("pg_sd"), F.when(count, mu).alias("mu"), F.when(count, s2).alias("s2"),
    )


def latent_responses(cells: DataFrame, cell: Column, seed: int, chain: int, iteration: int) -> DataFrame:
    """site, species, z: a draw of each latent response. cells(site, species, family, y, l, sigma); cell: a number of its own.

    Normal: as observed. Presence: a normal on its side of 0. Count: with a drawn Polya-Gamma weight. Missing: from the
    predictor, 0 for a count. Two streams a cell, and no shuffle.
    """
    df = cells.select("site", "species", "family", "y", "l", "sigma", cell.alias("cell"))
    for k in (0, 1):
        df = draws.with_normal(draws.with_uniform(df, f"u{k}", seed, chain, iteration, F.col("cell"), k), f"n{k}", f"u{k}")
    df = draws.with_truncated_normal(df, "t", F.col("l"), F.col("sigma"), F.when(F.col("y") > 0, 0.0), F.when(F.col("y") <= 0, 0.0), "u0")
    m, s = polya_gamma(F.col("y") + NB_R, F.col("l") - log(NB_R))
    prior = 1 / (F.col("sigma") * F.col("sigma"))
    df = df.withColumn("w", F.abs(m + s * F.col("n0"))).withColumn("var", 1 / (prior + F.col("w")))
    count = F.col("var") * ((F.col("y") - NB_R) / 2 + F.col("w") * log(NB_R) + F.col("l") * prior) + F.sqrt("var") * F.col("n1")
    free = F.when(F.col("family") == 3, 0.0).otherwise(F.col("l") + F.col("sigma") * F.col("n0"))
    z = F.when(F.col("y").isNull(), free).when(F.col("family") == 1, F.col("y")).when(F.col("family") == 2, F.col("t")).otherwise(count)
    return df.select("site", "species", z.alias("z"))


def joint_equations(x: DataFrame, covs: list[int], scores: DataFrame, factors: list[int], cells: DataFrame) -> DataFrame:
    """species, p, r: the normal equations of coefficients and loadings together, coefficients first.

    scores(site, factor, v): each site's scores, factors of all levels numbered in a row. A site is one wide row.
    """
    wide = widen(x, "site", "cov", covs, "x", "x").join(widen(scores, "site", "factor", factors, "v", "e"), "site")
    return equations(cells.join(wide, "site"), [*(f"x{c}" for c in covs), *(f"e{f}" for f in factors)], F.col("id"), "species", F.coalesce("z", F.lit(0.0)))


def coefficient_priors(iv: DataFrame, gamma: DataFrame, traits: DataFrame, precision: DataFrame, covs: int) -> DataFrame:
    """species, a, b, v: what the priors add to joint_equations, to the right side as b = -1. precision(species, factor, prec)."""
    species = traits.select("species").distinct()
    block = species.crossJoin(iv).select("species", F.col("c1").alias("a"), F.col("c2").alias("b"), "v")
    mean = contract(gamma, traits, ["trait"], ["cov", "species"], vb="t").withColumnRenamed("cov", "c2")
    pull = contract(iv, mean, ["c2"], ["c1", "species"]).select("species", F.col("c1").alias("a"), F.lit(-1).alias("b"), "v")
    own = precision.select("species", (F.col("factor") + covs).alias("a"), (F.col("factor") + covs).alias("b"), F.col("prec").alias("v"))
    return block.unionByName(pull).unionByName(own)


def residual_precision(cells: DataFrame, a: Column, b: Column) -> DataFrame:
    """species, shape, rate of the Gamma from which a residual precision is drawn; cells(species, z, l), z null if missing."""
    e = F.col("z") - F.col("l")
    return cells.groupBy("species").agg(F.count("z").alias("n"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("ss")).select("species", (a + F.col("n") / 2).alias("shape"), (b + F.col("ss") / 2).alias("rate"))


def normal_equations(x: DataFrame, covs: list[int], cells: DataFrame) -> DataFrame:
    """species, a, b, v: X'DX, and X'Dz as b = -1. cells(site, species, z, id).

    Sites carry their covariates as columns, so a cell makes one row, not one per pair of covariates.
    """
    wide = widen(x, "site", "cov", covs, "x", "x")
    return gram(cells.join(wide, "site"), [f"x{c}" for c in covs], F.col("id"), ["species"], F.coalesce("z", F.lit(0.0)))


def coefficient_residuals(beta: DataFrame, gamma: DataFrame, traits: DataFrame) -> DataFrame:
    """cov, species, v: Beta - Gamma T'."""
    mean = contract(gamma, traits, ["trait"], ["cov", "species"], vb="t")
    return beta.unionByName(mean.select("cov", "species", (-F.col("v")).alias("v"))).groupBy("cov", "species").agg(F.sum("v").alias("v"))


def self_product(rows: DataFrame, axis: str, over: list[str], value: str = "v") -> DataFrame:
    """axis1, axis2, v: sums of products of the rows with themselves over the shared axes."""
    a = rows.select(F.col(axis).alias(f"{axis}1"), *over, F.col(value).alias("_a"))
    b = rows.select(F.col(axis).alias(f"{axis}2"), *over, F.col(value).alias("_b"))
    return a.join(b, over).groupBy(f"{axis}1", f"{axis}2").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def level_residuals(fixed: DataFrame, ran: DataFrame, cells: DataFrame) -> DataFrame:
    """level, unit, site, species, s, id: what is left of cells(site, species, z, id) for each level without its own part.

    fixed(site, species, v) and ran(level, unit, site, species, v). All three meet in one aggregate by site and species.
    """
    none = lambda t: F.lit(None).cast(t)
    own = F.struct("level", "unit", "v")
    rows = fixed.select("site", "species", F.col("v").alias("f"), none("double").alias("z"), none("double").alias("id"), none("struct<level:int,unit:int,v:double>").alias("own"))
    rows = rows.unionByName(cells.select("site", "species", none("double").alias("f"), "z", "id", none("struct<level:int,unit:int,v:double>").alias("own")))
    rows = rows.unionByName(ran.select("site", "species", none("double").alias("f"), none("double").alias("z"), none("double").alias("id"), own.cast("struct<level:int,unit:int,v:double>").alias("own")))
    met = rows.groupBy("site", "species").agg(F.sum("f").alias("f"), F.max("z").alias("z"), F.max("id").alias("id"), F.sum("own.v").alias("all"), F.collect_list("own").alias("owns"))
    left = F.col("z") - F.col("f") - F.col("all") + F.col("o.v")
    return met.filter("id is not null").select("site", "species", "z", "id", "f", "all", F.explode("owns").alias("o")).select("o.level", "o.unit", "site", "species", left.alias("s"), "id")


def residuals_at_cells(cells: DataFrame) -> DataFrame:
    """As level_residuals, of design.at_cells() of cells(site, species, z, id): no cell is shuffled."""
    own = cells.select("site", "species", "z", "id", "f", total("owns").alias("all"), F.explode("owns").alias("o"))
    return own.select("o.level", "o.unit", "site", "species", (F.col("z") - F.col("f") - F.col("all") + F.col("o.v")).alias("s"), "id")


def score_statistics(cells: DataFrame, lam: DataFrame) -> DataFrame:
    """level, unit, h, k, v: precision of the scores, and the linear part as k = -1. cells(level, unit, species, s, id): s
    without the level's own part.

    Sites fold into units before anything meets the loadings, and one pass over the units makes both parts.
    """
    folded = cells.groupBy("level", "unit", "species").agg(F.sum(F.col("id") * F.coalesce("s", F.lit(0.0))).alias("ds"), F.sum("id").alias("id"))
    wide = lam.groupBy("level", "species").agg(F.collect_list(F.struct("h", "v")).alias("ls"))
    out = lambda a, k, v: F.struct(a["h"].alias("h"), k.alias("k"), v.alias("v"))
    linear = F.transform("ls", lambda a: out(a, F.lit(-1), F.col("ds") * a["v"]))
    square = F.flatten(F.transform("ls", lambda a: F.transform("ls", lambda b: out(a, b["h"], F.col("id") * a["v"] * b["v"]))))
    parts = folded.join(wide, ["level", "species"]).select("level", "unit", F.explode(F.concat(linear, square)).alias("c"))
    return parts.groupBy("level", "unit", "c.h", "c.k").agg(F.sum("c.v").alias("v"))


def score_statistics_with_covariates(cells: DataFrame, lam: DataFrame, covariates: DataFrame) -> DataFrame:
    """As score_statistics for loadings lam(level, h, species, c, v) that depend on covariates(level, unit, c, v) of the unit.

    Loadings are those of the unit before anything is summed: a unit's covariates are one small map, met once by each of
    its species, so the products grow with the factors squared and not with the covariates squared.
    """
    folded = cells.groupBy("level", "unit", "species").agg(F.sum(F.col("id") * F.coalesce("s", F.lit(0.0))).alias("ds"), F.sum("id").alias("id"))
    wide = lam.groupBy("level", "species", "h").agg(F.collect_list(F.struct("c", "v")).alias("cs")).groupBy("level", "species").agg(F.collect_list(F.struct("h", "cs")).alias("hs"))
    of_unit = covariates.groupBy("level", "unit").agg(as_map("c", "v").alias("x"))
    met = folded.join(of_unit, ["level", "unit"]).join(wide, ["level", "species"])
    own = F.transform("hs", lambda a: F.struct(a["h"].alias("h"), dot(a["cs"], "c", "v", F.col("x")).alias("v")))
    met = met.select("level", "unit", "ds", "id", own.alias("ls"))
    out = lambda a, k, v: F.struct(a["h"].alias("h"), k.alias("k"), v.alias("v"))
    linear = F.transform("ls", lambda a: out(a, F.lit(-1), F.col("ds") * a["v"]))
    square = F.flatten(F.transform("ls", lambda a: F.transform("ls", lambda b: out(a, b["h"], F.col("id") * a["v"] * b["v"]))))
    parts = met.select("level", "unit", F.explode(F.concat(linear, square)).alias("p"))
    return parts.groupBy("level", "unit", "p.h", "p.k").agg(F.sum("p.v").alias("v"))


def common_precision(pi: DataFrame, cells: DataFrame) -> DataFrame:
    """level, common: do all units of the level see the same summed precision for every species?"""
    by_unit = cells.join(pi, ["level", "site"]).groupBy("level", "unit", "species").agg(F.sum("id").alias("id"))
    of = by_unit.groupBy("level", "species").agg((F.max("id") - F.min("id") <= 1e-9 * F.max("id")).alias("same"), F.count("*").alias("n"))
    return of.groupBy("level").agg((F.bool_and("same") & (F.min("n") == F.max("n"))).alias("common"))


def loading_precision(psi: DataFrame, delta: DataFrame) -> DataFrame:
    """level, h, species, prec: psi times the running product of delta."""
    tau = delta.select("level", "h", cumulative_product(F.col("v"), ["level"], "h").alias("tau"))
    return psi.join(tau, ["level", "h"]).select("level", "h", "species", (F.col("v") * F.col("tau")).alias("prec"))


def shrinkage(lam: DataFrame, psi: DataFrame, delta: DataFrame, constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rates of the local precisions (level, h, species, a_psi, b_psi), and of the global ones at the current delta
    (level, h, tau, m, ad, bd). constants(level, nu, a1, b1, a2, b2)."""
    t = delta.select("level", "h", F.col("v").alias("delta"), cumulative_product(F.col("v"), ["level"], "h").alias("tau"))
    cell = lam.withColumnRenamed("v", "lambda").join(psi.withColumnRenamed("v", "psi"), ["level", "h", "species"]).join(t, ["level", "h"]).join(constants, "level")
    local = cell.select("level", "h", "species", (F.col("nu") / 2 + 0.5).alias("a_psi"), (F.col("nu") / 2 + F.col("lambda") * F.col("lambda") * F.col("tau") / 2).alias("b_psi"))
    m = cell.groupBy("level", "h", "delta", "tau", "a1", "b1", "a2", "b2").agg(F.sum(F.col("psi") * F.col("lambda") * F.col("lambda")).alias("m"), F.count("*").alias("n"))
    rest = suffix_sum(F.col("tau") * F.col("m"), ["level"], "h") / F.col("delta")
    left = suffix_sum(F.lit(1), ["level"], "h")
    first = F.col("h") == 0
    return local, m.select("level", "h", "tau", "m", (F.when(first, F.col("a1")).otherwise(F.col("a2")) + F.col("n") * left / 2).alias("ad"), (F.when(first, F.col("b1")).otherwise(F.col("b2")) + rest / 2).alias("bd"))


def sequential_delta(over: DataFrame, constants: DataFrame, draw: Column) -> DataFrame:
    """level, h, v: global precisions drawn one after the other, each with those before it as drawn and those after it as
    they were. over: shrinkage()'s second table; draw: of each, a standard Gamma draw of its shape `ad`.

    A level's factors are one short array; the fold carries the product of what has been drawn.
    """
    rest = suffix_sum(F.col("tau") * F.col("m"), ["level"], "h") / F.col("tau")
    rows = over.join(constants.select("level", "b1", "b2"), "level").select("level", F.struct("h", F.when(F.col("h") == 0, F.col("b1")).otherwise(F.col("b2")).alias("b"), rest.alias("rest"), draw.cast("double").alias("g")).alias("x"))
    state = lambda before, out: F.struct(before.alias("before"), out.alias("out"))
    one = lambda s, x: x["g"] / (x["b"] + s["before"] * x["rest"] / 2)
    begin = state(F.lit(1.0), F.array().cast("array<struct<h:int,v:double>>"))
    done = F.aggregate("xs", begin, lambda s, x: state(s["before"] * one(s, x), F.concat(s["out"], F.array(F.struct(x["h"].cast("int").alias("h"), one(s, x).alias("v"))))), lambda s: s["out"])
    return rows.groupBy("level").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("level", F.inline(done))


def factor_action(lam: DataFrame, bounds: DataFrame, iteration: int) -> DataFrame:
    """level, h, share, redundant, action (add, drop or keep, of the level). bounds(level, nf_min, nf_max)."""
    share = lam.groupBy("level", "h").agg(F.avg((F.abs("v") < 1e-3).cast("double")).alias("share"))
    of = share.groupBy("level").agg(F.count("*").alias("nf"), F.max("share").alias("most")).join(bounds, "level")
    gone = F.col("most") >= 1.0
    add = (F.col("nf") < F.col("nf_min")) | ((F.col("nf") < F.col("nf_max")) & F.lit(iteration > 20) & (F.col("most") < 0.995))
    action = F.when(add, "add").when((F.col("nf") > F.col("nf_min")) & gone, "drop").otherwise("keep")
    return share.join(of.select("level", action.alias("action")), "level").select("level", "h", "share", (F.col("share") >= 1.0).alias("redundant"), "action")


def selection_odds(x: DataFrame, beta: DataFrame, cells: DataFrame, mask_parts: DataFrame, groups: DataFrame, species: DataFrame, prior: DataFrame) -> DataFrame:
    """sel, grp, ll0, ll1, p1. mask_parts(sel, cov, species, mask): the mask with all selections but sel.

    A cell holds its site's covariates as a list, so both its fits, without and with the selection, are made in its row.
    """
    inside = groups.select("sel", "cov", F.lit(True).alias("inside"))
    own = F.col("v") * F.col("mask")
    terms = mask_parts.join(beta, ["cov", "species"]).join(inside, ["sel", "cov"], "left").groupBy("sel", "species")
    terms = terms.agg(as_map("cov", F.when(F.col("inside").isNull(), own).otherwise(0.0)).alias("b0"), as_map("cov", own).alias("b1")).join(species, ["sel", "species"])
    rows = with_lists(cells.join(by_site(x), "site"), terms, "species", ["sel", "grp", "b0", "b1"])
    cell = rows.select("z", "id", "_e.sel", "_e.grp", dot(F.col("xs"), "cov", "x", F.col("_e.b0")).alias("off"), dot(F.col("xs"), "cov", "x", F.col("_e.b1")).alias("on"))
    ll = lambda f: F.sum(-0.5 * F.col("id") * (F.col("z") - F.col(f)) * (F.col("z") - F.col(f)))
    out = cell.groupBy("sel", "grp").agg(ll("off").alias("l0"), ll("on").alias("l1")).join(prior, ["sel", "grp"])
    ll0, ll1 = F.col("l0") + F.ln(1 - F.col("q")), F.col("l1") + F.ln("q")
    return out.select("sel", "grp", ll0.alias("ll0"), ll1.alias("ll1"), (1 / (1 + F.exp(F.least(ll0 - ll1, F.lit(700.0))))).alias("p1"))


def reduced_rank_equations(xr: DataFrame, beta: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """h, k, g, l, v and h, k, v. xr(site, k, x), beta(h, species, v), cells(site, species, s, id)."""
    pairs = beta.select("species", "h", F.col("v").alias("bh")).join(beta.select("species", F.col("h").alias("g"), F.col("v").alias("bg")), "species")
    inner = cells.join(pairs, "species").groupBy("site", "h", "g").agg(F.sum(F.col("id") * F.col("bh") * F.col("bg")).alias("v"))
    other = xr.select("site", F.col("k").alias("l"), F.col("x").alias("y"))
    left = inner.join(xr, "site").join(other, "site").groupBy("h", "k", "g", "l").agg(F.sum(F.col("v") * F.col("x") * F.col("y")).alias("v"))
    pull = cells.join(beta, "species").groupBy("site", "h").agg(F.sum(F.col("id") * F.coalesce("s", F.lit(0.0)) * F.col("v")).alias("v"))
    return left, pull.join(xr, "site").groupBy("h", "k").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def rho_log_likelihood(rotated: DataFrame, eigen: DataFrame, iv: DataFrame, grid: DataFrame) -> DataFrame:
    """g, ll, p. rotated(cov, j, v): coefficient residuals in the eigenvectors' base; eigen(j, e); iv(c1, c2, v); grid(g, rho, pw).

    The quadratic form by eigenvalue does not depend on the grid: it is summed first, then meets the grid.
    """
    a = rotated.select(F.col("cov").alias("c1"), "j", F.col("v").alias("a"))
    b = rotated.select(F.col("cov").alias("c2"), "j", F.col("v").alias("b"))
    quad = a.join(iv, "c1").join(b, ["c2", "j"]).groupBy("j").agg(F.sum(F.col("a") * F.col("v") * F.col("b")).alias("quad"), F.countDistinct("c1").alias("nc"))
    e = F.col("rho") * F.col("e") + 1 - F.col("rho")
    ll = quad.join(eigen, "j").crossJoin(F.broadcast(grid)).groupBy("g", "pw").agg(F.sum(F.col("nc") * F.ln(e) + F.col("quad") / e).alias("s"))
    return _normalised(ll.select("g", (F.ln("pw") - F.col("s") / 2).alias("ll")), [])


def log_density_terms(cells: DataFrame, residuals: DataFrame, iv: DataFrame, eta: DataFrame, lam: DataFrame, precision: DataFrame) -> DataFrame:
    """term, v: the parts of the joint log density of coefficients, scores and loadings of normal responses, up to a constant.

    cells(site, species, z, id, l), z null and id 0 where missing; residuals(cov, species, v) of the coefficients from their
    mean; iv(c1, c2, v); precision(level, h, species, prec). Each part is one sum.
    """
    half = lambda df, name, x: df.agg((-0.5 * F.coalesce(F.sum(x), F.lit(0.0))).alias("v")).select(F.lit(name).alias("term"), "v")
    e = F.col("z") - F.col("l")
    a = residuals.select(F.col("cov").alias("c1"), "species", F.col("v").alias("a"))
    b = residuals.select(F.col("cov").alias("c2"), "species", F.col("v").alias("b"))
    data = half(cells, "responses", F.col("id") * e * e)
    coefficients = half(a.join(iv, "c1").join(b, ["c2", "species"]), "coefficients", F.col("a") * F.col("v") * F.col("b"))
    weighted = lam.join(precision, ["level", "h", "species"])
    return data.unionByName(coefficients).unionByName(half(eta, "scores", F.col("v") * F.col("v"))).unionByName(half(weighted, "loadings", F.col("prec") * F.col("v") * F.col("v")))


def integrated_density_terms(lam: DataFrame, delta: DataFrame, constants: DataFrame, ll: DataFrame) -> DataFrame:
    """term, v: the joint log density's parts of loadings and scores without their local precisions and ranges, up to a constant.

    Loadings are Student's t with nu degrees, scaled by the running product of delta; scores take the log of the sum over
    the grid of ll(h, g, ll), the likelihood of each factor's ranges. constants(level, nu).
    """
    scale = delta.select("level", "h", cumulative_product(F.col("v"), ["level"], "h").alias("tau"))
    t = 0.5 * F.ln("tau") - (F.col("nu") + 1) / 2 * F.log1p(F.col("tau") * F.col("v") * F.col("v") / F.col("nu"))
    loadings = lam.join(scale, ["level", "h"]).join(constants.select("level", "nu"), "level").agg(F.coalesce(F.sum(t), F.lit(0.0)).alias("v"))
    tops = ll.groupBy("h").agg(F.max("ll").alias("top"))
    by_factor = ll.join(tops, "h").groupBy("h", "top").agg(F.sum(F.exp(F.col("ll") - F.col("top"))).alias("s"))
    scores = by_factor.agg(F.coalesce(F.sum(F.col("top") + F.ln("s")), F.lit(0.0)).alias("v"))
    return loadings.select(F.lit("loadings").alias("term"), "v").unionByName(scores.select(F.lit("scores").alias("term"), "v"))


def _normalised(ll: DataFrame, by: list[str]) -> DataFrame:
    return ll.withColumn("p", softmax(F.col("ll"), by))


def quadratic_log_likelihood(eta: DataFrame, precision: DataFrame, grid: DataFrame) -> DataFrame:
    """h, g, ll, p. eta(unit, h, v), precision(g, unit, unit2, w) as cells, grid(g, pw, log_det)."""
    other = eta.select(F.col("unit").alias("unit2"), "h", F.col("v").alias("v2"))
    quad = precision.join(eta, "unit").join(other, ["unit2", "h"]).groupBy("h", "g").agg(F.sum(F.col("v") * F.col("w") * F.col("v2")).alias("quad"))
    return _normalised(quad.join(grid, "g").select("h", "g", (F.ln("pw") - F.col("log_det") / 2 - F.col("quad") / 2).alias("ll")), ["h"])
