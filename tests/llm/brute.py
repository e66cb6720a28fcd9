"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def kept_words(rows, width=13):
    """Words left per row after windows of documents with smaller ids are cut."""
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(i, first.get(x, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def least_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    shared = defaultdict(int)
    by_token = defaultdict(list)
    for i in sorted(sets):
        for t in sets[i]:
            for j in by_token[t]:
                shared[j, i] += 1
            by_token[t].append(i)
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return {i: len(s) for i, s in sets.items()}, least_reachable(sets, links)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def sha256(data):
    return hashlib.sha256(data).hexdigest()


GOLDEN, PAIR_MIX, M64 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def importance_kept(rows, labels, seed="gumbel"):
    """Ids kept of (id, text) rows and {id: good or not}: counts in dictionaries, rates tried at every weight, sorted keys."""
    import math
    import zlib

    import xxhash

    def grams(text):
        h = [zlib.crc32(w) * GOLDEN & M64 for w in (text or "").encode().lower().split()]
        return [("w", a >> 46) for a in h], [("p", ((a * 3 + b) * PAIR_MIX & M64) >> 46) for a, b in zip(h, h[1:])]

    def held(i):  # as Spark's xxhash64 of the name and the id
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(f"{seed}-held".encode(), 42))
        return (h - (1 << 64) * (h >> 63)) % 5 == 0

    raw, target = defaultdict(int), defaultdict(int)
    for i, t in rows:
        for g in (g for part in grams(t) for g in part):
            raw[g] += 1
            target[g] += bool(labels.get(i)) and not held(i)
    totals = {k: (sum(n for g, n in raw.items() if g[0] == k), sum(n for g, n in target.items() if g[0] == k)) for k in "wp"}

    def ratio(g):
        all_, good = totals[g[0]]
        shrink = 10 if g[0] == "w" else 30
        return math.log((target[g] + shrink) / (raw[g] * good / all_ + shrink)) if good else 0.0

    def weight(text):
        w, p = grams(text)
        return 250 * (sum(map(ratio, w)) + 0.3 * sum(map(ratio, p))) / len(w) if w else 0.0

    def noise(i):
        u = ((xxhash.xxh64_intdigest(f"{seed}:{i}") >> 11) + 0.5) / (1 << 53)
        return -math.log(-math.log(u))

    weights = [(i, weight(t)) for i, t in rows]
    good = [w for i, w in weights if i in labels and labels[i] and held(i)]
    bad = [w for i, w in weights if i in labels and not labels[i] and held(i)]
    least = -math.inf
    if good and bad:
        at = sorted({*good, *bad})
        rate = [sum(g >= x for g in good) / len(good) + sum(b < x for b in bad) / len(bad) for x in at]
        k = rate.index(max(rate))
        least = (at[k - 1] + at[k]) / 2 if k else at[0]
    n = sum(w >= least for _, w in weights)
    keys = sorted(((w + noise(i), i) for i, w in weights), key=lambda x: -x[0])
    return [i for _, i in keys[:n]]


def holds_item(text, items):
    """Does 10 of 12 consecutive words of an item (all but a sixth of a shorter one) stand on one diagonal?"""
    import math

    import regex

    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    own = defaultdict(list)
    for k, w in enumerate(split(text)):
        own[w].append(k)
    for item in items:
        w = split(item)
        width = min(len(w), 12)
        enough = math.ceil(width * 10 / 12)
        agree = defaultdict(set)
        for k, x in enumerate(w):
            for at in own.get(x, ()):
                agree[at - k].add(k)
        if w and any(sum(s + k in same for k in range(width)) >= enough for same in agree.values() for s in range(len(w) - width + 1)):
            return True
    return False


def redacted(text):
    """Base spans cut out, overlapping ones as one."""
    out, at = "", 0
    for kind, a, b in sorted(base_secrets(text), key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))):
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, b)
    return None if text is None else out + text[at:]
