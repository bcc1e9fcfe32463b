"""Near duplicates, mixing and tokens from plain strings, without the operators' code."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations


def shingles(text, size=5):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return Counter(runs or ([tuple(words)] if words else []))


def weighted_jaccard(a, b, value):
    union = a | b
    return sum(value[s] * c for s, c in (a & b).items()) / sum(value[s] * c for s, c in union.items()) if union else 0.0


def near_classes(docs, threshold=0.8, least=1):
    """id to the smallest id reachable by links, for (id, text) with distinct ids; counts run over all texts.

    Frequencies below ``least`` count as ``least``, to show what flattened weights would change.
    """
    bags = {i: shingles(t) for i, t in docs if t}
    n = sum(t is not None for _, t in docs)
    df = Counter(s for bag in bags.values() for s in bag)
    value = {s: 1 + math.log((n + 1) / (max(c, least) + 1)) for s, c in df.items()}
    holders = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            holders[s].append(i)
    pairs = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in pairs if weighted_jaccard(bags[a], bags[b], value) >= threshold]
    same = defaultdict(list)
    for i, t in docs:
        if t:
            same[t].append(i)
    links += [(ids[0], i) for ids in same.values() for i in ids[1:]]
    of = {i: i for i, _ in docs}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(of[a], of[b])
            moved |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def topic(text):
    t = text or ""
    if " | " in t:
        return "table"
    if "!! " in t:
        return "shout"
    if "\n- " in t or "\n* " in t:
        return "list"
    return "brief" if len(t) < 600 else "prose"


def mixed_ids(docs, powers=(0.7, 0.8, 0.9), sweeps=25, budget=0.75):
    """Ids that stay of (id, text, source, lang): raked cells, then a hash below the cell's probability."""
    tokens = {i: len(re.findall(r"[^ \t\n\r\f\x0b]+", t or "")) for i, t, _, _ in docs}
    cell = {i: (s, g, topic(t)) for i, t, s, g in docs}
    own = Counter()
    for i, c in cell.items():
        own[c] += tokens[i]
    own = {c: v for c, v in own.items() if v}
    total = sum(own.values())

    def margin(x, m):
        out = defaultdict(float)
        for c, v in x.items():
            out[c[m]] += v
        return out

    share = {c: v / total for c, v in own.items()}
    wanted = []
    for m, power in enumerate(powers):
        raw = {k: v**power for k, v in margin(share, m).items()}
        wanted.append({k: v / sum(raw.values()) for k, v in raw.items()})
    x = dict(share)
    for _ in range(sweeps):
        for m, target in enumerate(wanted):
            now = margin(x, m)
            x = {c: v * target[c[m]] / now[c[m]] for c, v in x.items()}
    weight = {c: x[c] / share[c] for c in x}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(v * min(1, mid * weight[c]) for c, v in own.items()) < budget * total else (low, mid)
    place = lambda i: int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 2**52
    return {i for i, c in cell.items() if not tokens[i] or place(i) < min(1, high * weight[c])}
