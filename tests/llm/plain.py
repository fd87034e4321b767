"""Plain versions of the operators' results, for small data: no Spark, no cleverness."""

import hashlib
import math
import re
from itertools import combinations


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def ngram_components(rows, size, percent):
    """(doc_id, text) rows to {doc_id: (n_shingles, component)}; ids are unique here."""
    sets = {i: shingles(t, size) for i, t in rows}
    filled = [(i, s) for i, s in sets.items() if s]
    links = [
        (a, b)
        for (a, x), (b, y) in combinations(filled, 2)
        if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)
    ]
    label = components(sets, links)
    return {i: (len(s), label[i]) for i, s in sets.items()}


def near_vectors(rows, cosine):
    """(vec_id, embedding, label) rows to {vec_id: (n_links, component)}."""
    usable = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = (label, v, math.sqrt(math.fsum(x * x for x in v)))
    links = []
    for (a, (la, x, nx)), (b, (lb, y, ny)) in combinations(usable.items(), 2):
        if la == lb and len(x) == len(y) and math.fsum(p * q for p, q in zip(x, y)) / (nx * ny) >= cosine:
            links.append((a, b))
    label = components([r[0] for r in rows], links)
    count = dict.fromkeys(label, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], label[i]) for i in label}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    """Base spans as {kind: [(start, end)]}."""
    text = text or ""
    found = {k: [] for k in ("email", "ip", "card", "phone")}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found["phone"].append(m.span())
    return found


def secrets(text):
    text = text or ""
    found = {k: [] for k in ("assign", "access", "hex")}
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text):
        if len(m[2]) >= 6:
            found["assign"].append(m.span())
    found["access"] = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found["hex"] = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return found


def digest(found, kinds, by_start=False):
    spans = [(kinds.index(k), s, e, k) for k, all_ in found.items() for s, e in all_]
    spans.sort(key=lambda x: (x[1], x[0]) if by_start else (x[0], x[1]))
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for _, s, e, k in spans).encode()).hexdigest()


def sha256(data):
    return hashlib.sha256(data).hexdigest()
