"""Random draws as columns: a value follows from (seed, chain, iteration, cell), whatever partition a row lies in.

A counter-based generator (Threefry, two words of 32 bits, 20 rounds; Salmon and others 2011) turns a key and a cell's
number into bits. Each round is a projection of its own, so its terms stay short and compiled; nothing is shuffled and no
state is kept, so a task that runs again draws the same. The same rules on numpy arrays serve tasks that work on batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Threefry's rotations and parity.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
WORD = 0xFFFFFFFF
ROUNDS = 20

# Rational approximations of the normal quantile (Wichura 1988), numerator and denominator from the constant on.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# The normal tail as exp(-x^2 / 2) times a rational function (Hart 1968), from the constant on.
TAIL = (
    (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2),
    (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2),
)
ROOT_2PI = 2.506628274631
#: Beyond it a tail's probability is near the least positive number: the tail is taken as exponential in x^2.
LAST = 36.0


def words(k0, k1, c0, c1):
    """Threefry's two output words, of whole numbers or of numpy arrays of 64 bits."""
    keys = (k0, k1, k0 ^ k1 ^ PARITY)
    x0, x1 = (c0 + k0) & WORD, (c1 + k1) & WORD
    for n in range(ROUNDS):
        r = ROTATIONS[n % 8]
        x0 = (x0 + x1) & WORD
        x1 = ((x1 << r) & WORD | x1 >> (32 - r)) ^ x0
        if n % 4 == 3:
            i = n // 4 + 1
            x0, x1 = (x0 + keys[i % 3]) & WORD, (x1 + keys[(i + 1) % 3] + i) & WORD
    return x0, x1


def key_of(seed: int, chain: int, iteration: int) -> tuple[int, int]:
    return words(seed & WORD, seed >> 32 & WORD, chain & WORD, iteration & WORD)


def _with_words(df: DataFrame, k: tuple[Column, Column], c: tuple[Column, Column]) -> DataFrame:
    """df with _x0 and _x1: words() of columns."""
    own = df.columns
    df = df.select("*", *(x.cast("long").alias(n) for n, x in zip(("_k0", "_k1", "_c0", "_c1"), (*k, *c), strict=True)))
    keys = (F.col("_k0"), F.col("_k1"), F.col("_k0").bitwiseXOR(F.col("_k1")).bitwiseXOR(F.lit(PARITY)))
    df = df.select(*own, "_k0", "_k1", (F.col("_c0") + keys[0]).bitwiseAND(F.lit(WORD)).alias("_x0"), (F.col("_c1") + keys[1]).bitwiseAND(F.lit(WORD)).alias("_x1"))
    for n in range(ROUNDS):
        r, x1 = ROTATIONS[n % 8], F.col("_x1")
        total = (F.col("_x0") + x1).bitwiseAND(F.lit(WORD))
        turned = F.shiftleft(x1, r).bitwiseAND(F.lit(WORD)).bitwiseOR(F.shiftright(x1, 32 - r))
        df = df.select(*own, "_k0", "_k1", total.alias("_x0"), turned.bitwiseXOR(total).alias("_x1"))
        if n % 4 == 3:
            i = n // 4 + 1
            df = df.select(*own, "_k0", "_k1", *((F.col(x) + keys[(i + j) % 3] + j * i).bitwiseAND(F.lit(WORD)).alias(x) for j, x in enumerate(("_x0", "_x1"))))
    return df.select(*own, "_x0", "_x1")


def with_uniform(df: DataFrame, name: str, seed: int, chain: int | Column, iteration: int | Column, cell: Column, stream: int = 0) -> DataFrame:
    """df with a uniform number inside (0, 1). cell: a whole number; stream: which of a cell's numbers.

    A chain or an iteration that all rows share is best given as a number: then its rounds are done once. The cell must not
    be a literal column.
    """
    own = df.columns
    df = df.withColumn("_cell", cell.cast("long"))
    if isinstance(chain, Column) or isinstance(iteration, Column):
        chain, iteration = (x if isinstance(x, Column) else F.lit(x) for x in (chain, iteration))
        # a zero that no planner folds: it would write all rounds of literals into one term
        zero = F.col("_cell") - F.col("_cell")
        df = _with_words(df, (F.lit(seed & WORD), F.lit(seed >> 32 & WORD)), (chain + zero, iteration + zero)).withColumnsRenamed({"_x0": "_key0", "_x1": "_key1"})
        key = F.col("_key0"), F.col("_key1").bitwiseXOR(F.lit(stream))
    else:
        k0, k1 = key_of(seed, chain, iteration)
        key = F.lit(k0), F.lit(k1 ^ stream)
    df = _with_words(df, key, (F.shiftrightunsigned("_cell", 32), F.col("_cell").bitwiseAND(F.lit(WORD))))
    u = (F.shiftright("_x0", 5) * (1 << 26) + F.shiftright("_x1", 6) + 0.5) / float(1 << 53)
    return df.select(*(c for c in own if c != name), u.alias(name))


def uniforms(seed: int, chain: int, iteration: int, cells, stream: int = 0):
    """The same numbers for a numpy array of cells."""
    import numpy as np

    k0, k1 = key_of(seed, chain, iteration)
    cells = np.asarray(cells, np.int64).view(np.uint64)
    x0, x1 = words(np.uint64(k0), np.uint64(k1 ^ stream), cells >> np.uint64(32), cells & np.uint64(WORD))
    return ((x0 >> np.uint64(5)).astype(float) * (1 << 26) + (x1 >> np.uint64(6)).astype(float) + 0.5) / (1 << 53)


def polynomial(x, terms):
    return reduce(lambda s, c: s * x + c, reversed(terms[:-1]), terms[-1])


def _rational(x, of):
    return polynomial(x, of[0]) / polynomial(x, of[1])


def with_normal(df: DataFrame, name: str, p: str) -> DataFrame:
    """df with the normal quantile of column p, a probability inside (0, 1), to 16 digits also in the lower tail."""
    own = df.columns
    q = F.col(p) - 0.5
    df = df.select(*own, q.alias("_q"), F.when(F.abs(q) <= 0.425, 0.180625 - q * q).otherwise(F.sqrt(-F.ln(F.least(F.col(p), 1 - F.col(p))))).alias("_r"))
    r = F.col("_r")
    tail = F.when(r <= 5, _rational(r - 1.6, NEAR)).otherwise(_rational(r - 5, FAR))
    return df.select(*(c for c in own if c != name), F.when(F.abs("_q") <= 0.425, F.col("_q") * _rational(r, CENTRE)).otherwise(F.signum("_q") * tail).alias(name))


def normals(p):
    """The same for a numpy array."""
    import numpy as np

    q = p - 0.5
    middle = np.abs(q) <= 0.425
    r = np.where(middle, 0.180625 - q * q, np.sqrt(-np.log(np.minimum(p, 1 - p))))
    tail = np.where(r <= 5, _rational(r - 1.6, NEAR), _rational(r - 5, FAR))
    return np.where(middle, q * _rational(r, CENTRE), np.sign(q) * tail)


def lower_tail(x: Column) -> Column:
    """The normal distribution function; in the lower tail to 8 digits of itself at least, down to -38. x: a plain column."""
    a = F.abs(x)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, _rational(a, TAIL)).otherwise(1 / (far * ROOT_2PI))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def with_truncated_normal(df: DataFrame, name: str, mean: Column, sd: Column, low: Column, high: Column, u: str) -> DataFrame:
    """df with a normal draw between low and high (null: no bound) by the quantile of uniform u.

    What lies above the mean is drawn as its mirror image, so all probabilities are those of lower tails, which keep
    their digits; where these end, the tail is exponential in x^2.
    """
    own = df.columns
    wide = F.lit(1e300)
    df = df.select(*own, F.coalesce((low - mean) / sd, -wide).alias("_a"), F.coalesce((high - mean) / sd, wide).alias("_b"))
    up = F.col("_a") > 0
    df = df.select(*own, up.alias("_up"), F.when(up, -F.col("_b")).otherwise(F.col("_a")).alias("_lo"), F.when(up, -F.col("_a")).otherwise(F.col("_b")).alias("_hi"))
    bounded = lambda c: F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col(c)))
    df = df.withColumns({"_l": bounded("_lo"), "_h": bounded("_hi")})
    below, upto = lower_tail(F.col("_l")), lower_tail(F.col("_h"))
    df = df.withColumn("_p", F.greatest(F.lit(1e-320), F.least(F.lit(1 - 2.0**-53), below + F.col(u) * (upto - below))))
    df = with_normal(df, "_x", "_p")
    last = -F.sqrt(F.col("_hi") * F.col("_hi") - 2 * F.ln(u))
    x = F.greatest("_lo", F.least("_hi", F.when(F.col("_hi") < -LAST, last).otherwise(F.col("_x"))))
    return df.select(*(c for c in own if c != name), (mean + sd * F.when(F.col("_up"), -x).otherwise(x)).alias(name))


def categorical(rows: DataFrame, by: list[str], pick: str, logit: str, u: str) -> DataFrame:
    """by and pick: one row of each group, with probability in proportion to exp(logit); u: a uniform of each row.

    The largest of logit + Gumbel noise wins, so it is one maximum: summed up partially before the shuffle, without a sort
    or a normaliser. A logit of null, or minus infinity, is never picked if there is another.
    """
    noisy = F.coalesce(F.col(logit), F.lit(float("-inf"))) - F.ln(-F.ln(u))
    return rows.withColumn("_noisy", noisy).groupBy(*by).agg(F.max_by(pick, "_noisy").alias(pick))
