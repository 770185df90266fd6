"""Plain Python versions of the Merkle manifest, SimHash near-dedup and importance resampling."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import xxhash

from . import messy


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*fields) -> str:
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _up(nodes):
    """Each level's nodes, and for each leaf its siblings (left, right) by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 3])) for i in range(0, len(x), 3)])
    paths = []
    for k in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            path.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            k //= 3
        paths.append(path)
    return levels[-1][0] if nodes else None, paths


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((leaf(*r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        found[s] = _up([x for x, _ in trees[s]])
    root, tops = _up([found[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (own, r), path in zip(trees[s], found[s][1], strict=True):
            steps, node = path + top, own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf(*r[:4], r[4].replace("\n", ""))
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r[0], own, found[s][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return out


def fingerprint(text) -> int:
    w = messy.space_words(text)
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, close):
    """For each value the set of all values that it reaches."""
    values, parent = list(values), {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if close(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def simhash(rows, distance=4):
    fps = [fingerprint(t) for _, t in rows]
    root = classes(dict.fromkeys(fps), lambda a, b: (a ^ b).bit_count() <= distance)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)]


def buckets(text, n=10_000) -> Counter:
    w = messy.plain_words(text)
    return Counter(zlib.crc32(" ".join(w[k : k + g]).encode()) % n for g in (1, 2, 3) for k in range(len(w) - g + 1))


def resample(docs, target, percent=5, least_words=20, n=10_000):
    """(doc_id, n_features, weight, score, rank) of docs (doc_id, text)."""
    each = [buckets(t, n) for _, t in docs]
    s, t = sum(each, Counter()), sum((buckets(x, n) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n)))) for b in s}
    rows = []
    for (i, text), c in zip(docs, each, strict=True):
        weight = sum(gain[b] * k for b, k in c.items())
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, sum(c.values()), weight, score, len(messy.plain_words(text)) >= least_words))
    able = sorted((r for r in rows if r[4] and r[3] is not None), key=lambda r: (-r[3], r[0], -r[2], -r[1]))
    drawn = Counter(r[:4] for r in able[: percent * len(able) // 100])
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    out = []
    for r in rows:
        mine = rank.get(r[:4]) if r[4] and drawn[r[:4]] else None
        out.append((*r[:4], mine.pop(0) if mine else None))
    return out
