"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups' roots, and each row's proof.

Rows are put in order by a range partitioning of narrow rows (no texts); a row's place in its group is a prefix sum of
the partitions' counts. A tree is cut into aligned blocks of 2^HEIGHT nodes. Going up, every block becomes one node of the
next table, until each group is one node; the groups' roots go up in the same way, as one more tree. Going down, the
paths of a table's nodes are those inside their blocks followed by their block's own path, which all its nodes share.

Inside a block, paths are made leaf by leaf: the path at hand changes where the next leaf needs another sibling, and a
treehash stack for each height prepares the sibling that comes next. All stacks share a budget of steps a leaf, which
goes to the stack whose lowest node is lowest, so that the nodes at hand grow with a block's height, not with its size.

A node is H of up to two consecutive nodes: the last of an odd row is hashed alone, and has no sibling there.
H is SHA-256 in lowercase hex, of digests as hex text.

Defined cases: a null value is written `-`, so it differs from an empty one; rows of a null group come first; a null id
comes first in its group; rows of one id are leaves of their own, in the order of their digests (equal leaves share
one result); a lone leaf is its group's root, a lone group's root is the whole one; a very long text is one leaf, hashed
once; an empty table gives no rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored, tasks_for

#: Levels of a block: 1,024 nodes are in one task's memory at a time.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where the sibling stands: before the node, after it, or nowhere.
BEFORE, AFTER, ALONE = "<", ">", "."
PATH = "path array<struct<side:string,node:string>>"


def h(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def leaf_of(columns: list[Column]) -> Column:
    """H of values, each `-` if null, else its bytes' number, `:` and itself."""
    written = (F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns))
    return F.sha2(F.concat(*written), 256)


class TreeHash:
    """Makes the node over leaves first to first + 2^height - 1 (as many as there are), a step at a time, on a stack."""

    def __init__(self, leaves: list[str], first: int, height: int):
        self.leaves, self.height = leaves, height
        self.next, self.end = first, min(first + (1 << height), len(leaves))
        self.stack: list[tuple[int, str]] = []
        self.done = first >= len(leaves)  # no such node

    @property
    def node(self) -> str | None:
        return self.stack[0][1] if self.stack else None

    def lowest(self) -> int:
        """The height that the next steps work at; of a finished one, beyond all."""
        return 1 << 30 if self.done else self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            height, right = s.pop()
            s[-1] = (height + 1, h(s[-1][1], right))
        elif self.next < self.end:
            s.append((0, self.leaves[self.next]))
            self.next += 1
        else:  # leaves have run out: the last node goes up alone
            s[-1] = (s[-1][0] + 1, h(s[-1][1]))
        self.done = self.next == self.end and len(s) == 1 and s[0][0] == self.height

    def finish(self) -> str | None:
        while not self.done:
            self.step()
        return self.node


def height_of(n: int) -> int:
    return max(0, n - 1).bit_length()


def traverse(leaves: list[str], height: int):
    """The path of each leaf in turn, as (side, sibling or None) from the leaf up."""
    size = len(leaves)
    path = [TreeHash(leaves, 1 << k, k).finish() for k in range(height)]  # of leaf 0: the second node of each height
    coming = [TreeHash(leaves, 0, k) for k in range(height)]
    for k, made in enumerate(coming):  # the first node of each height, from below
        made.stack, made.done = [(k, leaves[0] if k == 0 else h(coming[k - 1].node, *([path[k - 1]] if path[k - 1] else [])))], True
    for leaf in range(size):
        yield [(BEFORE if leaf >> k & 1 else AFTER if path[k] else ALONE, path[k]) for k in range(height)]
        ahead = leaf + 1
        for k in range(height):
            if ahead & ((1 << k) - 1):
                break
            path[k] = coming[k].finish()
            coming[k] = TreeHash(leaves, (ahead + (1 << k)) ^ (1 << k), k)
        for _ in range(2 * height - 1):
            low = min(coming, key=TreeHash.lowest)
            if low.done:
                break
            low.step()


def places(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows(g, ...) with pos, a row's place in its group g by `order` from 0, and n, its group's size."""
    spark = rows.sparkSession
    keys = [F.col("g").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), "tie"]
    spread = stored(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")  # by it, equal rows too are dealt to several tasks
    sorted_ = spread.repartitionByRange(tasks_for(spark), *keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    told = stored(sorted_, f"{name}-sorted").withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
    runs = told.groupBy("g", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("many"))
    of_group = Window.partitionBy("g")
    base = runs.select(F.col("g").alias("g_"), F.col("part").alias("part_"), (F.sum("many").over(of_group.orderBy("part")) - F.col("many") - F.col("first")).alias("base"), F.sum("many").over(of_group).alias("n"))
    return told.join(base, (F.col("g") == F.col("g_")) & (F.col("part") == F.col("part_"))).withColumn("pos", F.col("row") + F.col("base")).drop("at", "part", "row", "g_", "part_", "base")


def above(nodes: DataFrame, height: int) -> DataFrame:
    """The next table of nodes (g, pos, n, node): one for each block of nodes."""

    def run(x):
        import pyarrow as pa

        x = x.sort_by("pos")
        n = x.column("n")[0].as_py()
        node = TreeHash(x.column("node").to_pylist(), 0, min(height, height_of(n))).finish()
        return pa.table([x.column("g")[:1], pa.array([x.column("pos")[0].as_py() >> height]), pa.array([-(-n >> height)]), pa.array([node])], ["g", "pos", "n", "node"])

    blocks = nodes.select("g", "pos", "n", "node", F.shiftright("pos", height).alias("block"))
    return stored(blocks.groupBy("g", "block").applyInArrow(run, "g string, pos long, n long, node string"), "merkle-nodes")


def paths(nodes: DataFrame, upper: DataFrame | None, height: int, kept: list[str]) -> DataFrame:
    """kept columns and the path of each node of a table, from the table above (g, pos, path, others), if there is one, whose others are kept too."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = nodes.withColumn("block", F.shiftright("pos", height))
    others = [c for c in upper.columns if c not in ("g", "pos", "path")] if upper else []
    kind = pa.list_(pa.struct([("side", pa.string()), ("node", pa.string())]))
    fields = [*blocks.select(*kept).schema, *(upper.select(*others).schema if others else [])]

    def run(x, *above):
        x = x.sort_by("pos")
        leaves = x.column("node").to_pylist()
        levels = min(height, height_of(x.column("n")[0].as_py()))
        top = above[0].to_pylist()[0] if above else {"path": []}
        found = [[*({"side": a, "node": b} for a, b in p), *top["path"]] for p in traverse(leaves, levels)]
        return pa.table([*(x.column(c) for c in kept), *(pa.array([top[c]] * len(leaves), types[c]) for c in others), pa.array(found, kind)], [*kept, *others, "path"])

    types = {c: to_arrow_schema(upper.select(c).schema).field(0).type for c in others}
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), PATH])
    grouped = blocks.groupBy("g", "block")
    if upper is None:
        return grouped.applyInArrow(lambda x: run(x), out)
    return grouped.cogroup(upper.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(lambda x, y: run(x, y), out)


def tree(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The tables of nodes from the given one up to that of one node a group."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    tables = [nodes]
    while most > 1:
        tables.append(above(tables[-1], height))
        most = -(-most >> height)
    return tables


def down(tables: list[DataFrame], top: DataFrame, height: int, kept: list[str]) -> DataFrame:
    """kept columns and the paths of the first table's nodes, from top (g, pos 0, path, others) of each group's root."""
    for i in range(len(tables) - 2, 0, -1):
        top = stored(paths(tables[i], top, height, ["g", "pos"]), "merkle-paths")
    return paths(tables[0], top, height, kept)


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row, and the columns to carry; fields are what a leaf is made of.

    path: from the leaf up to the root, of each level the sibling and the side where it stands.
    """
    carry = carry or {}
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # sorts as the group does, null first
    rows = docs.select(g.alias("g"), F.col(doc_id).alias("doc_id"), leaf_of([F.col(c) for c in fields]).alias("node"), *(c.alias(f"carry_{name}") for name, c in carry.items()))
    leaves = places(rows, "merkle-leaves", ["doc_id", "node"])
    tables = tree(leaves, height)
    groups = places(tables[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node"), "merkle-groups", ["of"])
    over = tree(groups, height)
    root = over[-1].first()
    end = over[-1].select("g", "pos", F.array().cast("array<struct<side:string,node:string>>").alias("path"))
    of_group = down(over, end, height, ["of", "node"]) if len(over) > 1 else groups.select("of", "node", F.array().cast("array<struct<side:string,node:string>>").alias("path"))
    top = stored(of_group.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot")), "merkle-top")
    carried = [f"carry_{name}" for name in carry]
    # where every group is a lone leaf, its path is the group's
    found = down(tables, top, height, ["doc_id", "node", *carried]) if len(tables) > 1 else leaves.drop("pos").join(top.drop("pos"), "g")
    return found.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "path", *(F.col(f"carry_{name}").alias(name) for name in carry))


def proof(path: Column) -> Column:
    """H of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda p: p["node"]), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    pair = lambda node, p: F.when(p["side"] == BEFORE, F.concat(p["node"], node)).when(p["side"] == AFTER, F.concat(node, p["node"])).otherwise(node)
    return F.aggregate(path, leaf, lambda node, p: F.sha2(pair(node, p), 256))
