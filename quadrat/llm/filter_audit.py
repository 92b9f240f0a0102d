"""Filter interaction audit: what each of five filters removes, by part of the corpus, in all 120 orders of them.

judge() tells of each row which filters it fails, as five bits; audit() counts. A row's first failing step in each
order comes from one table, 32 sets of failed filters by 120 orders: mapInArrow looks rows up in it, np.bincount
adds them up by part, order, step and label, and the arrays of all tasks are summed with a partial sum before the
shuffle. All other figures follow from these counts, as a filter that stands first removes all that fail it, and
one that stands last all that fail nothing else.

Filters (a word is a maximal run without ASCII white space; case counts): A, under 50 words; B, under 65 % distinct
words; C, over 5 % of the code points are A-Z; D, any of # $ % & * |; E, the same text as a row of smaller id.

Equal texts are met by their SHA-256. Texts that a larger share of all rows than HEAVY have number under 1 / HEAVY, so
these are broadcast; the other repeated texts are joined by a shuffle, in which no key can be hot. Ids and their labels
are met in the same way. Texts themselves are read once and never shuffled.

Defined cases: a null text is an empty one, which fails A and equals other empty texts; a null source is the part
of empty name; a null id is not smaller than any and none is smaller than it, so such a row never fails E, and
has no label; rows of one id are rows of their own, of which none fails E by another; a row is good or toxic if any
label of its id says so (a null label says nothing); a very long text is one row's work; an empty table has no
parts and gives no rows. Only id, text, source and the labels' three columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The share of all rows from which on a text is looked up in every task: at most 1 / HEAVY texts have it.
HEAVY = 1 / 2048
#: Parts that a task counts at a time: 120 orders x 6 steps x 4 labels of 8 bytes each.
PARTS = 512
BLANK = r"[\x20\x09-\x0D]+"


def first_failures():
    """A table: for each set of failed filters (a bit each) and each order, the step that removes, or 0."""
    import numpy as np

    table = np.zeros((1 << STEPS, len(ORDERS)), np.int64)
    for failed in range(1 << STEPS):
        for k, order in enumerate(ORDERS):
            table[failed, k] = next((s for s, f in enumerate(order, 1) if failed >> FILTERS.index(f) & 1), 0)
    return table


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at nothing but the text: A, B, C and D."""
    words = F.array_remove(F.split(text, BLANK), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return reduce(lambda a, b: a + b, (f.cast("int") * (1 << i) for i, f in enumerate(fails)))


def told_of(rows: DataFrame, key: str, facts: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows and what facts(k_, value) tell of their keys, as `value`; heavy: k_ of at most 1 / HEAVY keys, looked up in every task.

    Rows of a heavy key, and rows without a key, find nothing in the shuffled join and go to any of its tasks.
    """
    heavy = F.broadcast(heavy)
    often = F.broadcast(facts.join(heavy, "k_", "left_semi").select(F.col("k_").alias("of_"), F.col("value").alias("hot_value")))
    rest = facts.join(heavy, "k_", "left_anti").select(F.concat(F.lit("="), F.col("k_")).alias("at_"), "value")
    marked = rows.join(heavy.withColumn("hot_", F.lit(True)), F.col(key) == F.col("k_"), "left").join(often, F.col(key) == F.col("of_"), "left")
    place = F.when(F.col("hot_").isNotNull() | F.col(key).isNull(), F.col("spread").cast("string")).otherwise(F.concat(F.lit("="), F.col(key)))
    met = marked.withColumn("place_", place).join(rest, F.col("place_") == F.col("at_"), "left")
    return met.withColumn("value", F.coalesce("hot_value", "value")).select(*rows.columns, "value")


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id (as text), part, failed (bits: A 1, B 2, C 4, D 8, E 16), good, toxic of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
            F.sha2(whole, 256).alias("same"), own_failures(whole).alias("failed"), F.rand(11).alias("spread"),
        ),
        "filters",
    )
    many = HEAVY * rows.count()
    texts = rows.groupBy(F.col("same").alias("k_")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("value")).filter("n > 1")
    met = told_of(rows, "same", texts.select("k_", "value"), texts.filter(F.col("n") > many).select("k_"))
    told = met.select("id", "part", "spread", (F.col("failed") + F.when(F.col("doc_id") > F.col("value"), 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))
    said = (F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) for c in ("quality", "toxic"))
    of_ids = labels.groupBy(F.col("doc_id").cast("string").alias("k_")).agg(reduce(lambda a, b: a + 2 * b, said).alias("value"))
    ids = rows.groupBy(F.col("id").alias("k_")).count().filter(F.col("count") > many).select("k_")
    found = told_of(told, "id", of_ids, ids)
    value = F.coalesce(F.col("value"), F.lit(0))
    return found.select(F.col("id").alias("doc_id"), "part", "failed", (value % 2 == 1).alias("good"), (value >= 2).alias("toxic"))


def counts(judged: DataFrame) -> DataFrame:
    """part, filter_order, step (0: no step removes), rows, good, toxic: one row for each, zeros included."""
    labels = 4  # neither, good, toxic, both

    def add(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, size = first_failures(), len(ORDERS) * (STEPS + 1) * labels
        cell = np.arange(len(ORDERS)) * (STEPS + 1)

        def told(seen: dict, sums):
            n = len(seen)
            by = sums[: n * size].reshape(n * len(ORDERS), (STEPS + 1) * labels)
            parts = pa.array(np.repeat(np.array(list(seen), object), len(ORDERS)), pa.string())
            orders = pa.array(np.tile(np.arange(len(ORDERS), dtype=np.int32), n))
            return pa.RecordBatch.from_arrays([parts, orders, *(pa.array(np.ascontiguousarray(c)) for c in by.T)], ["part", "k", *cells])

        seen, sums = {}, np.zeros(PARTS * size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                x = b.slice(at, 2048)
                coded = x.column("part").dictionary_encode()
                names = coded.dictionary.to_pylist()
                # a part too many: what has been counted is told, and counting starts anew, PARTS parts at a time
                rounds = [names] if len(seen.keys() | set(names)) <= PARTS else [names[i : i + PARTS] for i in range(0, len(names), PARTS)]
                of, failed = coded.indices.to_numpy(), x.column("failed").to_numpy()
                label = x.column("good").to_numpy(zero_copy_only=False) + 2 * x.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                for i, some in enumerate(rounds):
                    if len(seen.keys() | set(some)) > PARTS:
                        yield told(seen, sums)
                        seen, sums = {}, np.zeros(PARTS * size, np.int64)
                    code = np.array([seen.setdefault(p, len(seen)) for p in some], np.int64)
                    mine = of // PARTS == i if len(rounds) > 1 else np.ones(len(of), bool)
                    p, f, y = code[of[mine] - i * PARTS], failed[mine], label[mine]
                    at_cell = (p[:, None] * len(ORDERS) * (STEPS + 1) + cell + table[f]) * labels + y[:, None]
                    here = np.bincount(at_cell.ravel())
                    sums[: len(here)] += here
        if seen:
            yield told(seen, sums)

    cells = [f"c{s}_{y}" for s in range(STEPS + 1) for y in range(labels)]
    sums = judged.select("part", "failed", "good", "toxic").mapInArrow(add, f"part string, k int, {', '.join(f'{c} long' for c in cells)}").groupBy("part", "k").agg(*(F.sum(c).alias(c) for c in cells))
    each = F.array(*(F.struct(F.lit(s).alias("step"), *(reduce(lambda a, b: a + b, (F.col(f"c{s}_{y}") for y in ys)).alias(name) for name, ys in (("rows", (0, 1, 2, 3)), ("good", (1, 3)), ("toxic", (2, 3))))) for s in range(STEPS + 1)))
    name = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("k") + 1)
    return sums.select("part", name.alias("filter_order"), F.inline(each))


def audit(judged: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every part, order and step."""
    of_order = Window.partitionBy("part", "filter_order")
    so_far = of_order.orderBy("step")  # step 0 comes first: what no step removes
    of_filter = Window.partitionBy("part", "filter")
    fails, unique = (F.max(F.when(F.col("step") == s, F.col("rows"))).over(of_filter) for s in (1, STEPS))
    found = counts(judged).withColumn("kept", F.sum("rows").over(of_order) - F.sum(F.when(F.col("step") > 0, F.col("rows")).otherwise(0)).over(so_far)).filter("step > 0")
    found = found.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    return found.select("part", "filter_order", "step", "filter", "kept", F.col("rows").alias("removed"), (fails - F.col("rows")).alias("redundant"), unique.alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("rows").over(of_filter).alias("shapley"))
