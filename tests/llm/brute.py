"""Plain-Python versions that the operators are held against."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(s):
    return ALNUM.findall(lower(s or ""))


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    seen, places = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for found in seen.values():
        if len(found) > 1:
            places |= {i + k for i in found for k in range(8)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(places),
        "base_failed": n < 20 or 100 * len(places) > 30 * n,
    }


def decontaminate(text, items):
    words = plain(text)
    hit, found = set(), set()
    for item, body in items:
        w = plain(body)
        n = min(10, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def base_scores(rows):
    tokens = lambda t: SPACED.findall(lower(t or "")) + [None]
    counts = Counter(w for d, t in rows if not held_out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(d, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n) for d, t in rows]


def mix_targets(sizes, share=1.5, most=2):
    """Source -> target, by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while True:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] = left * weight[s] / total
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= above


def edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]
