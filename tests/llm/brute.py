"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict


def line_dedup(rows, depth=3, similarity=0.8):
    """[(id, text)] -> [(id, text, n_lines, n_dropped)]; ids unique and not null."""
    lines, first = {}, {}
    for i, text in rows:
        for no, raw in enumerate((text if text is not None else "").split("\n")):
            t = [x for x in re.split(r"[ \t\x0b\f\r]+", raw) if x]
            if text is None or not t:
                continue
            masked = ["<*>" if re.search("[0-9]", x) else x for x in t]
            digits = sum(bool(re.search("[0-9]", x)) for x in t)
            if 100 * digits > 20 * len(t):
                keys = [("numbers", *t)]
            else:
                keys = [tuple(masked)]
                if sum(x != "<*>" for x in masked) - 1 >= similarity * len(t) - 1e-9:
                    keys += [(p, *masked[:p], *masked[p + 1:]) for p in range(depth, len(t)) if masked[p] != "<*>"]
            lines[i, no] = keys
            for k in keys:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        parts = text.split("\n")
        stay = [x for no, x in enumerate(parts) if (i, no) not in lines or min(first[k] for k in lines[i, no]) == i]
        out.append((i, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return out


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, k, percent):
    """[(id, text)] -> {(id, size, component)}; ids not null."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(i, low.get(find(a), i))
    return sorted((i, len(s), low[find(a)]) for a, (i, s) in enumerate(sets))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: size} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rate = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        above = [s for s in free if w[s] * rate > most * sizes[s]]
        if not above:
            return {s: most * sizes[s] if s in full else w[s] * rate for s in order}
        full |= set(above)


def verdict(url, rules):
    """(host, path, rule, verdict)."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, v in rules:
        dom, tail = rule.split("/", 1)
        if ("." + host).endswith("." + dom) and path.startswith("/" + tail):
            fits.append((len(rule), rule, v))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))
