"""Plain Python versions of the operators, for comparison on small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def op2(docs):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if d is not None and first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int(np.sum(gone & ~np.r_[False, gone[:-1]]))
        out.append((d, len(t), int(gone.sum()), runs, sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    return out


W3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def op3(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        if i is None or t is None:
            continue
        w = W3.findall(lower(t))
        for a in range(max(1, len(w) - 9)) if w else ():
            wins[tuple(w[a : a + 10])].add(i)
    lens = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = W3.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in lens:
            for a in range(len(w) - n + 1):
                k = tuple(w[a : a + n])
                if k in wins:
                    hit[a : a + n] = [True] * n
                    found |= wins[k]
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return out


W4 = re.compile(r"[^\x20\x09-\x0D]+")


def op4(docs):
    import xxhash

    fps = []
    for d, t in docs:
        w = W4.findall(lower(t or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    vals = sorted({f for _, f in fps})
    parent = {f: f for f in vals}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(vals):
        for b in vals[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in fps]


def op7(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = W4.findall(t)
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(wins)
        rep = set()
        for i, x in enumerate(wins):
            if c[x] > 1:
                rep |= set(range(i, i + 8))
        seen, dup = set(), 0
        for x in t.split("\n"):
            if W4.search(x):
                dup += x in seen
                seen.add(x)
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed))
    return out


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


P10 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def op10(docs):
    out = []
    for d, t in docs:
        spans, n = [], Counter()
        for k, (kind, p) in enumerate(P10.items()):
            for m in re.finditer(p, t or ""):
                v, digits = m.group(), re.sub("[^0-9]", "", m.group())
                ok = {
                    "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
                }[kind]
                if ok:
                    spans.append((m.start(), k, m.end(), kind))
                    n[kind] += 1
        text = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(spans))
        out.append((d, *(n[k] for k in P10), sha(text)))
    return out


def crc3(d):
    return zlib.crc32(str(d).encode()) % 3


def line_removals(docs):
    """Places (doc_id, idx) of the lines that line dedup takes out, from all pairs of distinct lines."""
    at = {}
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if re.search(r"\S", line):
                at.setdefault(line, []).append((doc_id, i))
    sets = sorted(((x, {x[i : i + 5] for i in range(len(x) - 4)} or {x}) for x in at), key=lambda p: len(p[1]))
    root = {x: x for x in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (x, a) in enumerate(sets):
        for y, b in sets[i + 1 :]:
            if len(a) < 0.8 * len(b):
                break
            common = len(a & b)
            if common / (len(a) + len(b) - common) >= 0.8:
                root[find(x)] = find(y)
    groups = {}
    for x, places in at.items():
        groups.setdefault(find(x), []).extend(places)
    return {p for places in groups.values() for p in places if p != min(places)}
