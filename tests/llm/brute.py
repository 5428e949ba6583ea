"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(i)
    sizes, out = {len(x) for x in windows}, {}
    for d, t in docs:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if x := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def near_groups(docs, k, num, den):
    sets = {}
    for d, t in docs:
        w = SPACED.findall(low(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def repeats(docs, length=50):
    first = {}
    for d, t in sorted(docs):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    out = {}
    for d, t in docs:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                mask[i : i + length] = b"\1" * length
        out[d] = (len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), bytes(x for x, m in zip(t, mask) if not m))
    return out


def base_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_places(text):
    w, starts, labels = ALNUM.findall(low(text)), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
