"""Slow, plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        w = TERM.findall(lower(text))
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        w = TERM.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key] - {None}
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def substrings(docs, n=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def jaccard_components(docs, n=5, share=75):
    sets = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        sets.append((doc, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(i)
    for i, (doc, s) in enumerate(sets):
        common = Counter(j for g in s for j in at[g] if j < i)
        for j, both in common.items():
            if 100 * both >= share * (len(s) + len(sets[j][1]) - both):
                a, b = root(doc), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return [(doc, len(s), root(doc)) for doc, s in sets]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """(start, rank, end) of the base patterns."""
    text = text or ""
    out = []
    for rank, p in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, rank == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][rank]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)
