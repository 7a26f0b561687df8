"""Plain Python versions of the contracts, for small tables."""

import re
from collections import Counter, defaultdict
from statistics import mean, variance

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(rows):
    """rows of (doc_id, text, source); the metrics, base_failed and kept."""
    out = []
    for d, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        m = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        out.append((d, source, m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    hosts = defaultdict(list)
    for _, s, _, failed in out:
        if s is not None:
            hosts[s].append(failed)
    rates = [sum(x) / len(x) for x in hosts.values()]
    m = mean(rates) if rates else 0.0
    v = variance(rates) if len(rates) > 1 else 0.0
    k = min(max(m * (1 - m) / v - 1 if v else 1e6, 1.0), 1e6)
    bad = {s for s, x in hosts.items() if (sum(x) + m * k) / (len(x) + k) > 0.5}
    return [(d, *met, failed, not failed and s not in bad) for d, s, met, failed in out]


def simhash(text):
    w = WORD.findall((text or "").translate(_LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    """rows of (doc_id, fp); component of each."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, fp, least.get(find(i))) for i, (d, fp) in enumerate(rows)]


def decontaminate(docs, items):
    """docs of (doc_id, text), items of (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(_LOWER))
        if w:
            for i in range(max(1, len(w) - 12)):
                windows[tuple(w[i : i + 13])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = ITEM_WORD.findall((text or "").translate(_LOWER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
