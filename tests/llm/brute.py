"""The operators once more, the slow and plain way."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def decontamination(docs, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {}
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if k else ():
            wins.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, got = split(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    got |= wins[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(map(str, got)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = lambda: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def repeats(texts, w=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + w] for b in raws for i in range(len(b) - w + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def jaccard(docs, k, num, den=100):
    sets = {}
    for d, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
        sets[d] = set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def topk(rows, k=20, every=20):
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for q, x in good:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def filter_audit(docs, labels):
    """docs: doc_id, text, source; labels: doc_id, quality, toxic."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        same = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), same), strict=True) if bad}
        rows.append((s or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(every) - len(gone), sum(len(r[1]) == 1 for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def merkle(docs):
    """docs: doc_id, source, lang, n_chars, text; what the contract's query returns."""
    written = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha("".join(map(written, d)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def way(tree, at):
        return [(at >> k & 1, x[at >> k ^ 1] if at >> k ^ 1 < len(x) else None) for k, x in enumerate(tree[:-1])]

    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((d for d in docs if d[2] == x), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))) for x in langs]
    trees = [levels([leaf(d) for d in g]) for g in groups]
    over = levels([t[-1][0] for t in trees])
    out = []
    for a, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for b, d in enumerate(g):
            path = way(t, b) + way(over, a)
            changed = d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            node = leaf((*d[:3], d[3] + 1, d[4])) if changed else leaf(d)
            for right, x in path:
                node = sha(node if x is None else x + node if right else node + x)
            out.append((d[0], leaf(d), t[-1][0], over[-1][0], sha("".join(x for _, x in path if x)), node, node == over[-1][0]))
    return sorted(out, key=str)
