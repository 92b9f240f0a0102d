"""N-gram Jaccard self-join: rare-first prefix filtering, exact verification, components of links.

A document is the set of its word k-grams. Documents of the same words in the same order (by SHA-256) are one class;
only its smallest id goes on. To find candidates, k-grams are hashed to 64 bits and ordered by how often they occur (partial
counts of the frequent ones, a bounded list; all others are rare) and then by hash: any two sets that are similar
enough share one of their first n - ceil(t n) + 1 n-grams in that order. Hashes only find candidates: sizes and
similarity are those of the words. Colliding hashes make a candidate more, and could hide a link only of two texts
each of which has different k-grams of equal hash itself.

Candidates are met by prefix n-gram in two steps, so that a group of many near copies never makes all its
pairs. First each n-gram's documents are paired with a hub of theirs (length and positional filters),
verified, and joined to components. Then, per n-gram, the pairs whose documents are still in different
components are all taken, with the length and suffix (parity) filters, and kept if they share enough
prefix n-grams; pairs inside a component cannot change the result. The suffix filter is a bound on what two
sets can share: each n-gram flips one bit of its set's parities, so two sets differ in at least as many n-grams as
bits. There are as many bits as the set's size asks for, so that copies of one text that are a little too far apart, and
long texts, are told apart before a row is made of a pair. Every pair is verified once, on the words of whole texts, with
the exact sizes of intersection and union. Components are the contract's; their number of verified links is not all
links.

No n-gram's documents go to one task: all prefix n-grams are counted, and the documents of one that occurs HOT times (of a
very large table: so often that at most MOST n-grams do) are dealt into salts, each of which has hubs of its own,
which then meet as the n-gram's documents in their turn; and the pairs of an n-gram are dealt by
pairs of blocks of its documents.

Texts travel only for documents in candidate pairs, once per hub and slice of its partners; a hub with many
partners is sliced. The scan drops other texts early by a bitmap of fixed size.

Defined cases: a text that is null or has no words has no set, is linked with nothing and is its own
component; a null id is linked with nothing and has a null component; rows of equal id are one document as
far as links go; equal texts are linked; ties between hubs go to the smaller id; very long texts are sets like
any other, compared whole; an empty table gives an empty result. Only id and text are read.
keep_one() decides per row: rows of one id are documents of their own there; rows with a null id all stay.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import sliced, small_batches, stored, tasks_for
from quadrat.llm.components import components

#: Frequent n-grams that are ordered by count; n-grams of a task among which those that occur again are counted at once.
FREQUENT, SLICE = 1 << 19, 1 << 22
BITMAP, PARTNERS, HUBS = 1 << 20, 64, 8
#: Bits of a set's parities, at least and at most: half as many as it has n-grams, as a power of two.
BITS, MOST_BITS = 1 << 10, 1 << 13
#: Occurrences of an n-gram beyond which its documents are dealt to several tasks, and documents of a block of pairs.
HOT, BLOCK = 1 << 14, 512
MOST = 1 << 14
#: Odd multipliers of the words of an n-gram.
MIX = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashed(words: list[bytes], k: int):
    """The hash of each k-gram in turn (the whole sequence if it is shorter), as uint64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    if n < 1:
        return np.array([xxh64_intdigest(h.tobytes(), seed=len(words))], np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX) + h[j : j + n]
    out ^= out >> np.uint64(32)
    return out * np.uint64(MIX)


def ngrams(text: str, k: int):
    """Sorted distinct hashes of the k-word n-grams, as uint64."""
    import numpy as np

    return np.unique(hashed(words_of(text), k))


def size_of(words: list[bytes], k: int, positions: int, distinct: int) -> int:
    """How many different k-grams there are; of hashes that are all different, there are as many."""
    return distinct if positions == distinct else len(set(zip(*(words[j:] for j in range(k)), strict=False)))


def overlap(a: list[bytes], b: list[bytes], k: int) -> tuple[int, int, int]:
    """The numbers of k-grams of two texts' words, and of those in both: words become numbers, k-grams numbers of numbers."""
    import numpy as np

    if min(len(a), len(b)) < k:
        return 1, 1, int(a == b)  # if one has k words or more, the other's only one is shorter
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(w, len(known)) for x in (a, b) for w in x), np.int64, len(a) + len(b))
    n, most = len(of) - k + 1, len(known)
    gram, upto = of[:n], len(known)
    for j in range(1, k):
        if upto >= (1 << 62) // most:
            seen, gram = np.unique(gram, return_inverse=True)
            upto = len(seen)
        gram, upto = gram * most + of[j : j + n], upto * most
    one, two = np.unique(gram[: len(a) - k + 1]), np.unique(gram[len(a) :])
    return len(one), len(two), len(np.intersect1d(one, two, assume_unique=True))


def overlap_needed(na, nb, t: Fraction):
    """The least intersection of sets of these sizes that are similar enough: ceil(t (na + nb) / (1 + t))."""
    up, down = t.numerator, t.numerator + t.denominator
    return -((-up * (na + nb)) // down)


def parities(s) -> bytes:
    """A bit for each bucket of hashes: whether an odd number of the set's (different) hashes lies in it. Of half as many bits, it is the halves' XOR."""
    import numpy as np

    bits = BITS
    while bits < MOST_BITS and 2 * bits < len(s):
        bits *= 2
    at = (s >> np.uint64(40)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


class Parities:
    """Of many sets; differ() is how many bits pairs of them differ in, at the length of the shorter."""

    def __init__(self, column):
        import numpy as np

        self.of = column.to_pylist()
        self.length = np.fromiter(map(len, self.of), np.int64, len(self.of))
        self.folded = {}

    def at(self, length: int):
        """(where each set is, the sets of at least this length as rows of words)"""
        import numpy as np

        if length not in self.folded:
            where, rows = np.cumsum(self.length >= length) - 1, []
            for size in np.unique(self.length[self.length >= length]).tolist():
                which = np.flatnonzero(self.length == size)
                x = np.frombuffer(b"".join(self.of[i] for i in which), np.uint64).reshape(len(which), -1)
                while x.shape[1] * 8 > length:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                rows.append((which, x))
            out = np.empty((sum(len(w) for w, _ in rows), length // 8), np.uint64)
            for which, x in rows:
                out[where[which]] = x
            self.folded[length] = where, out
        return self.folded[length]

    def differ(self, i, other: Parities, j):
        import numpy as np

        shorter, out = np.minimum(self.length[i], other.length[j]), np.zeros(len(i), np.int64)
        for length in np.unique(shorter).tolist():
            (wi, xi), (wj, xj) = self.at(length), other.at(length)
            which = np.flatnonzero(shorter == length)
            for lo in range(0, len(which), (1 << 22) // length):  # so many at once that they take 4 MB
                some = which[lo : lo + (1 << 22) // length]
                out[some] = np.bitwise_count(xi[wi[i[some]]] ^ xj[wj[j[some]]]).sum(1, dtype=np.int64)
        return out


def ids_and_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def frequent(docs: DataFrame, k: int):
    """Up to FREQUENT n-grams that occur in many documents: hashes (sorted) and counts."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        def told(parts):
            x = np.concatenate(parts)
            parts.clear()
            x.sort()
            again = x[1:][x[1:] == x[:-1]]  # one less than it occurs
            h, c = np.unique(again, return_counts=True)
            c += 1
            keep = np.arange(len(h)) if len(h) <= FREQUENT // 4 else np.argsort(-c, kind="stable")[: FREQUENT // 4]
            return pa.RecordBatch.from_pydict({"h": h[keep].view(np.int64), "c": c[keep]})

        parts, size = [], 0
        for b in sliced(batches):
            for t in b.column("text").to_pylist():
                parts.append(ngrams(t, k))
                size += len(parts[-1])
                if size >= SLICE:
                    yield told(parts)
                    size = 0
        if parts:
            yield told(parts)

    told = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    got = told.orderBy(F.col("c").desc(), "h").limit(FREQUENT).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def hot_of(rows: DataFrame) -> list[tuple[int, int]]:
    """Of rows(g, ...), the n-grams that are dealt to several tasks, and to how many: at most MOST of them, by exact counts."""
    counts = rows.groupBy("g").count()
    often = counts.filter(F.col("count") > HOT).withColumn("all", F.sum("count").over(Window.partitionBy()))
    share = F.greatest(F.lit(HOT), F.ceil(F.col("all") / MOST))
    return [tuple(r) for r in often.filter(F.col("count") > share).select("g", F.ceil(F.col("count") / share)).collect()]


def sets_of(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """doc_id, n, rare (n-grams per thousand that are not frequent), digest (of the words), prefix (n-grams, rarest first), parity (by bucket of hash)."""
    import numpy as np

    known, often = frequent(docs, k)
    shared = docs.sparkSession.sparkContext.broadcast((known, often))

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        known, often = shared.value
        for b in sliced(batches):
            ns, rares, digests, prefixes, odd = [], [], [], [], []
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(x)
                every = hashed(words, k)
                s = np.unique(every)
                n = len(s)
                ns.append(size_of(words, k, len(every), n))
                if not n or doc is None:
                    rares.append(None)
                    digests.append(None)
                    prefixes.append(None)
                    odd.append(None)
                    continue
                digests.append(sha256(b" ".join(words)).digest())
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, often[at], 0)
                rares.append(int((rank == 0).sum()) * 1000 // n)
                first = n + ((-t.numerator * n) // t.denominator) + 1
                prefixes.append(s[np.lexsort((s, rank))[:first]].view(np.int64))
                odd.append(parities(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(rares, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(odd, pa.binary())], ["doc_id", "n", "rare", "digest", "prefix", "parity"])

    return stored(docs.mapInArrow(run, "doc_id long, n long, rare long, digest binary, prefix array<long>, parity binary"), "sets")


def met(rows: DataFrame, t: Fraction) -> DataFrame:
    """meet() of rows(g, a, n, rare, pos), with the hubs of a hot n-gram's salts met once more."""
    spark, hot = rows.sparkSession, hot_of(rows)
    if not hot:
        return meet(rows.withColumn("salt", F.lit(0)), t)
    salts = F.broadcast(spark.createDataFrame(hot, "g long, salts long"))  # at most MOST rows
    salt = F.when(F.col("salts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("a"), "salts")).cast("int")
    first = meet(rows.join(salts, "g", "left").select("g", "a", "n", "rare", "pos", salt.alias("salt")), t)
    hubs = first.filter("kind = 2").select("g", "a", "n", F.lit(0).cast("long").alias("rare"), "pos", F.lit(0).alias("salt"))
    return first.filter("kind < 2").union(meet(hubs, t).filter("kind = 0"))


def meet(rows: DataFrame, t: Fraction) -> DataFrame:
    """Of n-grams that several sets have: kind 0, pairs a, b with a hub of the n-gram; kind 1, the rows themselves; kind 2, the hubs of a salt.

    Rows arrive sorted by n-gram, those with the fewest rare n-grams first: what copies were made from has
    few, its edited copies have more. Each row is paired with the first hub of a size that fits, or becomes
    one itself (up to HUBS). The rows are read as a stream: the hubs are all that is remembered. All rows of a
    salt are told, as those that share its n-gram may be in other salts.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, hubs, only = None, [], None
        for b in sliced(batches, 8192):
            cols = [b.column(c).to_numpy() for c in ("g", "salt", "a", "n", "pos")]
            g, salt = cols[:2]
            like = (g[1:] == g[:-1]) & (salt[1:] == salt[:-1])
            same = salt > 0  # or with a neighbour in this batch, or with the batch before or after
            same[1:] |= like
            same[:-1] |= like
            if len(g):
                same[-1] = True
                same[0] |= at == (g[0], salt[0])
            out = []
            for g1, s1, a, n, pos in zip(*(c[same].tolist() for c in cols), strict=True):
                if at != (g1, s1):
                    at, hubs, only = (g1, s1), [(a, n, pos)], (1, g1, a, None, n, pos)
                    if s1:
                        out += [only, (2, *only[1:])]
                        only = None
                    continue
                if only:
                    out.append(only)
                    only = None
                out.append((1, g1, a, None, n, pos))
                for h, hn, hpos in hubs:
                    if min(hn, n) * t.denominator >= t.numerator * max(hn, n):
                        if min(n - pos, hn - hpos) >= overlap_needed(n, hn, t):
                            out.append((0, g1, min(a, h), max(a, h), None, None))
                        break
                else:
                    if len(hubs) < HUBS:
                        hubs.append((a, n, pos))
                        if s1:
                            out.append((2, g1, a, None, n, pos))
            kinds = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(kinds[0], pa.int32()), *[pa.array(x, pa.int64()) for x in kinds[1:]]], ["kind", "g", "a", "b", "n", "pos"])

    spread = rows.select("g", "salt", "a", "n", "rare", "pos").repartition(tasks_for(rows.sparkSession), "g", "salt").sortWithinPartitions("g", "salt", "rare", "a")
    return stored(spread.mapInArrow(run, "kind int, g long, a long, b long, n long, pos long"), "met")


def across(rows: DataFrame, t: Fraction) -> DataFrame:
    """All pairs of sets that share prefix n-grams, are in different components and pass the filters.

    rows: g, m (how many rows g has), a, n, label, parity, of n-grams that occur in several components. All
    n-grams that two sets share up to where the first of their prefixes ends are among these, and at most
    ceil(t n) - 1 come after a prefix: too few shared ones in the prefixes rule a pair out. An n-gram's rows
    are dealt into blocks of about BLOCK; each pair of blocks is a group of its own, so that no task needs
    all rows of an n-gram. What a task finds is counted before it tells of a pair.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(x, crossed):
            """Of one group, whose rows are sorted by n; crossed: of different blocks only."""
            a, n, label, own = (x.column(c).to_numpy() for c in ("a", "n", "label", "own"))
            odd = Parities(x.column("parity"))
            end = np.searchsorted(n, (n * t.denominator) // t.numerator, side="right")
            many = end - np.arange(len(a)) - 1
            lo = 0
            while lo < len(a):  # so many rows at once that their partners are about 16,384
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(many[lo:]), 1 << 14, side="right")) + lo)
                i = np.repeat(np.arange(lo, hi), many[lo:hi])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
                ok = (label[i] != label[j]) & (t.denominator * n[i] >= t.numerator * n[j])
                if crossed:
                    ok &= own[i] != own[j]
                i, j = i[ok], j[ok]
                for at in range(0, len(i), 1 << 15):
                    k, m = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                    ok = n[k] + n[m] - odd.differ(k, odd, m) >= 2 * overlap_needed(n[k], n[m], t)
                    k, m = k[ok], m[ok]
                    if len(k):
                        yield np.stack([np.minimum(a[k], a[m]), np.maximum(a[k], a[m]), n[k], n[m], np.ones(len(k), np.int64)], 1)
                lo = hi

        def summed(parts):
            x = np.concatenate(parts)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            first = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(1)])
            return np.c_[x[first, :4], np.add.reduceat(x[:, 4], first)]

        def told(x):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, c])) for c in range(5)], ["a", "b", "small", "large", "c"])

        def groups():
            """(the group's rows, crossed) one after the other."""
            held, at = [], None
            for b in sliced(batches, 8192):
                keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("g", "one", "two")], 1)
                cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.empty(0, int)
                for lo, hi in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
                    key = tuple(keys[lo].tolist())
                    if held and at != key:
                        yield pa.Table.from_batches(held), at[1] != at[2]
                        held = []
                    at = key
                    held.append(b.slice(lo, hi - lo))
            if held:
                yield pa.Table.from_batches(held), at[1] != at[2]

        parts, size = [], 0
        for x, crossed in groups():
            for p in pairs(x, crossed):
                parts.append(p)
                size += len(p)
                if size > 1 << 18:
                    parts = [summed(parts)]
                    size = len(parts[0])
                    if size > 1 << 17:
                        yield told(parts[0])
                        parts, size = [], 0
        if parts:
            yield told(summed(parts))

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("a"), blocks).cast("int")
    to = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("one"), F.greatest(x, F.col("own")).alias("two")))
    rows = rows.select("g", "m", own.alias("own"), "a", "n", "label", "parity").select("g", "own", "a", "n", "label", "parity", F.explode(to).alias("to")).select("g", "to.one", "to.two", "own", "a", "n", "label", "parity")
    spread = rows.repartition(tasks_for(rows.sparkSession), "g", "one", "two").sortWithinPartitions("g", "one", "two", "n", "a")
    shared = spread.mapInArrow(run, "a long, b long, small long, large long, c long").groupBy("a", "b", "small", "large").agg(F.sum("c").alias("c"))
    up, down = t.numerator, t.numerator + t.denominator
    needed = F.ceil((F.col("small") + F.col("large")) * up / F.lit(down) - 1e-9)
    later = F.ceil(F.col("large") * up / F.lit(t.denominator) + 1e-9) - 1
    return shared.filter(F.col("c") >= needed - later).select("a", "b")


def close(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Pairs whose parities and sizes allow the similarity (suffix filter), each once."""
    s = sets.select("doc_id", "n", "parity")
    a, b = (s.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in "ab")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for x in batches:
            if not x.num_rows:
                continue
            na, nb, each = x.column("na").to_numpy(), x.column("nb").to_numpy(), np.arange(x.num_rows)
            differ = Parities(x.column("pa")).differ(each, Parities(x.column("pb")), each)
            ok = pa.array(na + nb - differ >= 2 * overlap_needed(na, nb, t))
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], ["a", "b"])

    return pairs.distinct().join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs that are similar enough, by the n-grams of their whole texts."""
    import numpy as np

    spark = docs.sparkSession
    # the end with more pairs is the hub; its partners are dealt into slices of about PARTNERS
    ends = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).groupBy("d").count()
    ca, cb = ends.select(F.col("d").alias("a"), F.col("count").alias("na")), ends.select(F.col("d").alias("b"), F.col("count").alias("nb"))
    p = pairs.join(ca, "a").join(cb, "b")
    hub = F.when((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    p = p.select(hub.alias("hub"), F.when(hub == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("d"), F.greatest("na", "nb").alias("m"))
    p = p.select("hub", F.pmod(F.xxhash64("d"), F.ceil(F.col("m") / PARTNERS)).alias("part"), "d")
    items = stored(p.select("hub", "part", "d", F.lit(1).alias("role")).union(p.select("hub", "part", F.col("hub").alias("d"), F.lit(0).alias("role")).distinct()), "items")

    slots = items.select(F.pmod(F.xxhash64("d"), F.lit(BITMAP)).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(BITMAP, bool)
    bits[slots] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def wanted(batches):
        import pyarrow as pa

        bits = np.unpackbits(shared.value).astype(bool)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(bits[b.column("s").to_numpy()])) for x in (b.column("doc_id"), b.column("text"))], ["doc_id", "text"])

    texts = docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).cast("int").alias("s")).mapInArrow(wanted, "doc_id long, text string")
    sent = items.join(texts, items["d"] == texts["doc_id"]).select("hub", "part", "role", "d", "text")
    spread = sent.repartition(tasks_for(spark), "hub", "part").sortWithinPartitions("hub", "part", "role")

    def enough(one: int, two: int, both: int) -> bool:
        return both > 0 and t.denominator * both >= t.numerator * (one + two - both)

    def run(batches):
        import pyarrow as pa

        at, hubs = None, []
        for b in sliced(batches):
            a, d = [], []
            for hub, part, role, doc, text in zip(*(b.column(c).to_pylist() for c in ("hub", "part", "role", "d", "text")), strict=True):
                if at != (hub, part):
                    at, hubs = (hub, part), []
                words = words_of(text)
                s = np.unique(hashed(words, k))
                if role == 0:
                    hubs.append((s, words))
                    continue
                for h, of_hub in hubs:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    # hashes first, which cannot tell less than the words; then the words
                    if enough(len(h), len(s), both) and enough(*overlap(of_hub, words, k)):
                        a.append(min(hub, doc))
                        d.append(max(hub, doc))
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(d, pa.int64())})

    return stored(spread.mapInArrow(run, "a long, b long"), "similar")


def join(docs: DataFrame, *, k: int = 5, similarity: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every row."""
    small_batches(docs.sparkSession)
    docs = ids_and_texts(docs, doc_id, text)
    sets = sets_of(docs, k, similarity)
    classes = sets.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "rare", "prefix", "parity")).alias("r"))
    reps = stored(classes.select("digest", "r.*"), "classes")
    rows = reps.select(F.col("doc_id").alias("a"), "n", "rare", F.posexplode("prefix").alias("pos", "g"))
    near = met(rows.select("g", "a", "n", "rare", F.col("pos").cast("long").alias("pos")), similarity)

    first = stored(close(near.filter("kind = 0").select("a", "b"), reps, similarity), "first")
    links = verified(docs, first, k, similarity)
    labels = components(links)

    shared = near.filter("kind = 1").select("g", "a", "n")
    named = shared.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    mixed = named.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("g", "m")
    left = named.join(mixed, "g").join(reps.select(F.col("doc_id").alias("a"), "parity"), "a")
    second = stored(across(left, similarity).join(first, ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        labels = components(links.union(verified(docs, second, k, similarity)).union(labels.select("node", "label")))

    of_class = reps.select("digest", F.col("doc_id").alias("rep")).join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sets.select("doc_id", "n", "digest").join(of_class, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each component, that of its smallest id, and the rows without an id, with all columns.

    Where an id occurs again, ids do not tell rows apart: then a copy of the table is stored with a number
    for each row, and joined by that.
    """
    ids = docs.groupBy(F.col(doc_id).alias("id")).count()
    if ids.filter("id IS NOT NULL AND count > 1").isEmpty():
        gone = join(docs, doc_id=doc_id, **how).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
        return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc")), "rows")
    flat = rows.select("_row", F.col("_doc")[doc_id].alias("_id"), F.col("_doc")[how.get("text", "text")].alias("_text"))
    named = flat.filter("_id IS NOT NULL")
    found = join(named, doc_id="_row", **{**how, "text": "_text"})
    first = named.select("_row", "_id").join(found, F.col("_row") == found["doc_id"]).groupBy("component_id").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_first"))
    first = first.select("_first").union(flat.filter("_id IS NULL").select("_row"))
    return rows.join(first, rows["_row"] == first["_first"], "left_semi").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def links(docs: DataFrame, *, k: int = 5, similarity: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """component_id, n_docs, n_links of every component: all pairs of documents that are linked, also inside a component.

    As join(), but no candidate is left out, so that it takes as many pairs as there are: the square of a
    group of near copies. Copies (equal sets) are counted, not paired. Ids are taken to be distinct; rows
    without one are left out.
    """
    small_batches(docs.sparkSession)
    docs = ids_and_texts(docs, doc_id, text)
    sets = sets_of(docs, k, similarity)
    classes = sets.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "rare", "prefix", "parity")).alias("r"), F.count("*").alias("m"))
    reps = stored(classes.select("m", "r.*"), "classes")
    rows = reps.select(F.col("doc_id").alias("a"), "n", "rare", F.posexplode("prefix").alias("pos", "g"))
    near = met(rows.select("g", "a", "n", "rare", F.col("pos").cast("long").alias("pos")), similarity)
    # each set is its own component: nothing is skipped
    shared = near.filter("kind = 1").select("g", "a", "n", F.col("a").alias("label"))
    many = shared.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    pairs = stored(across(shared.join(many, "g").join(reps.select(F.col("doc_id").alias("a"), "parity"), "a"), similarity), "pairs")
    found = verified(docs, pairs, k, similarity)
    labels = components(found)

    m = reps.select("doc_id", "m")
    between = found.join(m.select(F.col("doc_id").alias("a"), F.col("m").alias("ma")), "a").join(m.select(F.col("doc_id").alias("b"), F.col("m").alias("mb")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.sum(F.col("ma") * F.col("mb")).alias("between"))
    each = m.join(between, "doc_id", "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    equal = F.expr("m * (m - 1) div 2")
    each = each.select(F.coalesce("label", "doc_id").alias("component_id"), "m", (equal + F.coalesce("between", F.lit(0))).alias("n"))
    none = sets.filter("digest is null and doc_id is not null").select(F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("m"), F.lit(0).cast("long").alias("n"))
    return each.union(none).groupBy("component_id").agg(F.sum("m").alias("n_docs"), F.sum("n").cast("long").alias("n_links"))
