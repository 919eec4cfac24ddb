"""Brute-force versions that the operators are held against."""

import hashlib
import re


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(rows):
    """{doc_id: (n, component)} by comparing every pair."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in ids}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def sound(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base_spans(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if sound(k, m.group())]
    return found, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def line_dedup(rows):
    """{doc_id: text} after removing lines under later occurrences of repeated three-line windows."""
    seen, out = set(), {}
    for k, t in sorted(rows):
        raw = (t or "").split("\n")
        flat = [x.strip(" \t\r\x0b\x0c") for x in raw]
        gone = set()
        for i in range(len(flat) - 2):
            w = tuple(flat[i : i + 3])
            if any(w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[k] = t if not gone else "\n".join(x for i, x in enumerate(raw) if i not in gone)
    return out
