"""Exact top-k search by inner product with an M-tree over the whole table, best node first.

Components become floor(64 x), scores are integer inner products. The tree: up to PIVOTS pivots, chosen from the
whole table by a hash, each with the rows that are nearest to it (a node: covering radius, each row's distance to
the pivot); above them tops with covering radii and each pivot's distance to its top; below them each node's rows
in parts of about ROWS rows, each part one stored row that holds the lower levels: pages of vectors around pivots
(covering radius, each vector's distance), and pages around pivots of pivots (each page's distance to its parent).
It is built once. By the triangle inequality <q, x> <= <q, p> + |q| d(x, p), so a stored distance gives a bound
without touching x: nodes and pages are visited by falling bound and left out once the bound is under the k-th
score so far, and in a page only vectors whose own bound reaches that score are multiplied.

Two rounds: a query first searches one part of the node of its best bound; its k-th score there is the bound it
takes along to all others, and nodes that cannot reach it are never visited. Queries that visit a part come in
blocks of bounded size; a part is copied once for each block of the queries that visit its node, and nowhere else.

Defined cases: null vectors and those that hold a null or a non-finite component take no part, as a query
or as a row; rows without an id neither; ties go to the smaller id; each row is a query or a candidate of its
own, also if its id or its vector occurs again: a query row has its own k results, listed under its id, among
all rows but itself, so that it may find other rows of its id, and a repeated candidate counts as often as it is
there; with fewer rows than k all are returned; a shorter vector counts as padded with zeros, and a long one is compared
whole; an empty table gives none. Scores are exact integers; vectors whose scores could leave 64 bits are refused with an error.
Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored

ROWS, QUERIES, PAGE, FAN = 8192, 4096, 128, 8
#: Pivots of the whole table, which go to every task, and the most components that they have together (32 MB).
PIVOTS, CELLS = 1024, 1 << 22
LOWEST = -(1 << 63)


def nearest(x, pivots):
    """Each row's nearest pivot and an upper bound of the distance to it."""
    import numpy as np

    at, near = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (pivots * pivots).sum(1)
    for lo in range(0, len(x), 4096):
        y = x[lo : lo + 4096]
        square = np.maximum((y * y).sum(1)[:, None] + norms[None, :] - 2 * (y @ pivots.T), 0)
        at[lo : lo + len(y)] = one = square.argmin(1)
        # again from the differences: exact enough whatever the size of the components
        near[lo : lo + len(y)] = np.sqrt(((y - pivots[one]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
    return at, near


def grouped(pivots):
    """Tops over pivots: the tops, each pivot's top, and its distance to it."""
    import numpy as np

    m = len(pivots)
    tops = pivots[(np.arange(max(1, m // FAN)) * m) // max(1, m // FAN)]
    return tops, *nearest(pivots, tops)


class Tree:
    """The lower levels of one part: flat arrays of pages and, above them, of pivots of pivots."""

    def __init__(self, keys, ids, x):
        import numpy as np

        order = np.lexsort((keys, ids))
        keys, ids, x = keys[order], ids[order], x[order]
        n = len(x)
        self.pages = pages = max(1, n // PAGE)
        pivots = np.unique(x[(np.arange(pages) * n) // pages], axis=0)
        near, dist = nearest(x, pivots)
        order = np.lexsort((dist, near))  # by page, then by distance to the pivot
        self.keys, self.ids, self.x, self.dist, near = keys[order], ids[order], x[order], dist[order], near[order]
        used, first = np.unique(near, return_index=True)
        self.pivots, self.first, self.last = pivots[used], first, np.r_[first[1:], n]
        self.radius = self.dist[self.last - 1]
        self.tops, self.parent, self.to_parent = grouped(self.pivots)
        self.cover = np.array([np.max((self.to_parent + self.radius)[self.parent == t], initial=0) for t in range(len(self.tops))])
        self.big = float((x * x).sum(1).max())

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps(self.__dict__, protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Tree:
        import pickle

        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(data))
        return tree

    def search(self, qkeys, q, k: int, limit):
        """Flat arrays query index, id, score: the k best of each query in this part that reach its limit, the k-th score so far."""
        import numpy as np

        norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        limit = limit.copy()
        # beyond exact doubles scores are products of 64-bit integers, and bounds get room for rounding
        big = max(self.big, float((q * q).sum(1).max())) >= 2**53
        x, qx = (self.x.astype(np.int64), q.astype(np.int64)) if big else (self.x, q)
        slack = norm * np.sqrt(self.big) * 1e-12 if big else np.zeros(len(q))
        top = q @ self.tops.T + norm[:, None] * self.cover[None, :] + slack[:, None]
        by_top = np.argsort(-top, axis=1, kind="stable")
        got = (np.empty(0, np.int64), np.empty(0, self.ids.dtype), np.empty(0, np.int64))
        for r in range(top.shape[1]):
            node = by_top[:, r]
            live = np.flatnonzero(top[np.arange(len(q)), node] >= limit)
            if not len(live):
                break
            for t in np.unique(node[live]):
                rows = live[node[live] == t]
                mine = np.flatnonzero(self.parent == t)
                # first by the stored distance to the parent, which needs no product with the page's pivot
                far = (q[rows] @ self.tops[t] + slack[rows])[:, None] + norm[rows, None] * (self.to_parent + self.radius)[None, mine]
                mine = mine[(far >= limit[rows, None]).any(0)]
                dots = q[rows] @ self.pivots[mine].T + slack[rows, None]
                bound = dots + norm[rows, None] * self.radius[None, mine]
                for j in np.argsort(-bound.max(0, initial=-np.inf), kind="stable"):
                    on = np.flatnonzero(bound[:, j] >= limit[rows])
                    if not len(on):
                        continue
                    page, who = mine[j], rows[on]
                    lo, hi = self.first[page], self.last[page]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        least = np.nanmin(np.where(norm[who] > 0, (limit[who] - dots[on, j]) / norm[who], -np.inf))
                    lo += np.searchsorted(self.dist[lo:hi], least)
                    s = (qx[who] @ x[lo:hi].T).astype(np.int64)
                    a, b = np.nonzero(s >= limit[who, None])
                    new = (who[a], self.ids[lo + b], s[a, b])
                    ok = self.keys[lo + b] != qkeys[new[0]]  # not itself
                    got = tuple(np.concatenate([g, x[ok]]) for g, x in zip(got, new, strict=True))
                    if len(got[0]) > 4 * k * len(q):
                        got = self.best(got, k, limit)
            got = self.best(got, k, limit)
        return got

    @staticmethod
    def best(got, k: int, limit):
        import numpy as np

        who, ids, s = got
        order = np.lexsort((ids, -s, who))
        who, ids, s = who[order], ids[order], s[order]
        start = np.searchsorted(who, who)
        rank = np.arange(len(who)) - start
        kth = rank == k - 1
        limit[who[kth]] = s[kth]
        keep = rank < k
        return who[keep], ids[keep], s[keep]


def matrix(lists, size: int | None = None):
    """Rows of a list column as a matrix, shorter ones padded with zeros."""
    import numpy as np

    lists = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    lists = lists.chunk(0) if hasattr(lists, "chunk") else lists
    off = np.asarray(lists.offsets)
    flat, off = np.asarray(lists.values, np.float64)[off[0] : off[-1]] if len(lists) else np.empty(0), off - off[0]
    n = np.diff(off)
    x = np.zeros((len(lists), max(1, n.max(initial=0)) if size is None else size))
    x[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1], n)] = flat
    return x


def whole(batches):
    """Rows whose vector has only finite components, as floor(64 x), with its squared length."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        b = b.filter(pc.and_(b.column("id").is_valid(), b.column("v").is_valid()))
        n = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
        z = np.asarray(b.column("v").flatten().fill_null(np.nan))
        with np.errstate(over="ignore"):
            y = np.floor(64.0 * z)
        row = np.repeat(np.arange(len(n)), n)
        keep = np.bincount(row, ~np.isfinite(z), len(n)) == 0
        if (np.isfinite(z) & np.isinf(y) & keep[row]).any():
            raise ValueError(OVER)
        y = np.where(np.isfinite(y), y, 0)
        v = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(y))
        yield pa.RecordBatch.from_arrays([b.column("id"), v, pa.array(np.bincount(row, y * y, len(n)))], ["id", "v", "square"]).filter(pa.array(keep))


OVER = "scores of these vectors can leave 64 bits"


def search(vectors: DataFrame, k: int = 20, *, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by every."""
    import numpy as np

    spark = vectors.sparkSession
    kind = "query_id long, rank int, vec_id long, score long"
    good = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(whole, "id long, v array<double>, square double")
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    n, nq, longest, size = good.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max("square"), F.max(F.size("v"))).first()
    if not nq:
        return spark.createDataFrame([], kind)
    if longest >= 2**63:
        raise ValueError(OVER)
    size = max(1, size)
    many = max(1, min(PIVOTS, CELLS // size, -(-n // ROWS)))
    chosen = good.select("v", F.xxhash64("id", F.lit(11)).alias("h"), "id").orderBy("h", "id").limit(many).select("v").toArrow().column("v")
    pivots = np.unique(matrix(chosen, size), axis=0)
    shared = spark.sparkContext.broadcast((pivots, *grouped(pivots)))

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            node, dist = nearest(matrix(b.column("v"), size), shared.value[0])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("v"), pa.array(node.astype(np.int32)), pa.array(dist)], ["key", "id", "v", "node", "dist"])

    rows = stored(good.select(F.monotonically_increasing_id().alias("key"), "id", "v").mapInArrow(assign, "key long, id long, v array<double>, node int, dist double"), "vectors")
    radius, parts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for node, held, far in rows.groupBy("node").agg(F.count("*"), F.max("dist")).collect():  # a row for each pivot
        radius[node], parts[node] = far, -(-held // ROWS)

    def build(key, table):
        import pyarrow as pa

        tree = Tree(table.column("key").to_numpy(), table.column("id").to_numpy(), matrix(table.column("v"), size))
        return pa.Table.from_pydict({"node": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([tree.dump()], pa.binary())})

    in_parts = F.get(F.array(*[F.lit(int(x)) for x in np.maximum(parts, 1)]), F.col("node"))
    pages = stored(rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), in_parts).cast("int")).groupBy("node", "part").applyInArrow(build, "node int, part int, tree binary"), "pages")

    def route(first: bool, counted: bool):
        """Which nodes a query visits: that of its best bound, or all that can reach its limit. Counted: how many queries visit a
        node; else a row for each part of the nodes, of the first round one part."""

        def run(batches):
            import pyarrow as pa

            p, tops, parent, to_parent = shared.value
            cover = np.array([np.max((to_parent + radius)[parent == t], initial=0) for t in range(len(tops))])
            visits = np.zeros(len(parts), np.int64)
            for b in batches:
                q = matrix(b.column("v"), size)
                norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
                slack = norm[:, None] * np.sqrt(longest) * 1e-12
                limit = b.column("limit").fill_null(LOWEST).to_numpy()
                live = (q @ tops.T + norm[:, None] * cover[None, :] + slack >= limit[:, None])[:, parent]
                bound = np.where(live, q @ p.T + norm[:, None] * radius[None, :] + slack, -np.inf)
                bound[:, parts == 0] = -np.inf
                if first:
                    who, node = np.arange(len(q)), bound.argmax(1)
                    part = np.zeros(len(q), np.int64)
                else:
                    who, node = np.nonzero((bound >= limit[:, None]) & (parts > 0)[None, :])
                if counted:
                    visits += np.bincount(node, minlength=len(visits))
                    continue
                if not first:
                    times = parts[node]
                    who, node = np.repeat(who, times), np.repeat(node, times)
                    part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                for lo in range(0, len(who), 8192):
                    at = pa.array(who[lo : lo + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 8192].astype(np.int32)), pa.array(part[lo : lo + 8192].astype(np.int32)), *[b.column(c).take(at) for c in ("key", "id", "v", "limit")]], ["node", "part", "key", "id", "v", "limit"])
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(visits), dtype=np.int32)), pa.array(visits)], ["node", "n"])

        return run

    def look(key, queries, page):
        import pyarrow as pa

        none = pa.Table.from_pydict({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not queries.num_rows or not page.num_rows:
            return none
        tree = Tree.load(page.column("tree")[0].as_py())
        keys, ids = queries.column("key").to_numpy(), queries.column("id").to_numpy()
        who, found, score = tree.search(keys, matrix(queries.column("v"), size), k, queries.column("limit").fill_null(LOWEST).to_numpy())
        return pa.Table.from_pydict({"query": pa.array(keys[who], pa.int64()), "query_id": pa.array(ids[who], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score)})

    def looked(queries: DataFrame, first: bool) -> DataFrame:
        # a node's parts are copied once for every QUERIES queries that visit it, and to nobody if none does
        blocks = np.zeros(len(parts), np.int64)
        for node, visits in queries.mapInArrow(route(first, True), "node int, n long").groupBy("node").agg(F.sum("n")).collect():  # a row for each pivot
            blocks[node] = -(-visits // QUERIES)
        of_node = F.get(F.array(*[F.lit(int(x)) for x in blocks]), F.col("node"))
        block = F.pmod(F.xxhash64("key", F.lit(5)), of_node).cast("int").alias("block")
        to = queries.mapInArrow(route(first, False), "node int, part int, key long, id long, v array<double>, limit long").select("*", block)
        of = (pages.filter("part = 0") if first else pages).filter(of_node > 0).select("*", F.explode(F.sequence(F.lit(0), (of_node - 1).cast("int"))).alias("block"))
        return to.groupBy("node", "part", "block").cogroup(of.groupBy("node", "part", "block")).applyInArrow(look, "query long, query_id long, vec_id long, score long")

    queries = rows.filter(is_query).select("key", "id", "v")
    kth = looked(queries.withColumn("limit", F.lit(None).cast("long")), True).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("limit")).filter(F.col("n") >= k)
    limited = stored(queries.join(kth, queries["key"] == kth["query"], "left").select("key", "id", "v", "limit"), "queries")
    found = looked(limited, False)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
