"""Plain-Python versions of the operators, and small fixtures with nulls, ties, repeated rows and long texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randrange(1, 6))) for _ in range(80)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 90))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for k in range(0, n, 6):
        texts[k] = f"{texts[k]}\n{passage} {texts[k]}"
    for k in range(1, n, 9):
        texts[k] = texts[k - 1]
    for k in range(2, n, 9):
        texts[k] = texts[k - 2] + " Z"
    texts += [None, "", " \t\n ", "one", "One two", "x " * 5000, "\n".join(["same line here"] * 40), "THE! " * 30]
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def rows_of(seed=3):
    """(doc_id, text, kept, size, block): columns with names that operators use themselves; a null id and repeated rows."""
    rows = corpus(seed)
    rows += [rows[5], rows[5], (None, "a text without an id"), (None, None)]
    return [(i, t, "mine", 7, "b") for i, t in rows]


SCHEMA = "doc_id long, text string, kept string, size int, block string"


def quality_base(text):
    words = WORD.findall(text or "")
    n, seen, same = len(words), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            same += line in seen
            seen.add(line)
    count = Counter(tuple(words[k : k + 8]) for k in range(n - 7))
    covered = {p for k in range(n - 7) if count[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), same, len(covered), n < 20 or 100 * len(covered) > 30 * n


def simhash_components(rows):
    import xxhash

    prints = []
    for _, t in rows:
        w = WORD.findall(lowered(t))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
        prints.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, f"{p:016x}", low.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))]


def without_repeats(rows):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in docs:
        gone = {p for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def ppm_scores(rows, trains, order=5):
    texts = [" ".join(WORD.findall(lowered(t))).encode() for _, t in rows]
    contexts = [defaultdict(Counter) for _ in range(order + 1)]
    for text, train in zip(texts, trains):
        b = b"\xff" * order + text + b"\xff"
        for p in range(order, len(b)) if train else ():
            for k in range(order + 1):
                contexts[k][b[p - k : p]][b[p]] += 1
    out = []
    for text in texts:
        b, s = b"\xff" * order + text + b"\xff", 0.0
        for p in range(order, len(b)):
            left_out = set()
            for k in range(order, -1, -1):
                seen = contexts[k].get(b[p - k : p])
                if not seen:
                    continue
                open_ = {x: n for x, n in seen.items() if x not in left_out}
                total, kinds = sum(open_.values()), len(open_)
                if b[p] in open_:
                    s += math.log10(open_[b[p]] / (total + kinds))
                    break
                if kinds:
                    s += math.log10(kinds / (total + kinds))
                left_out |= set(seen)
            else:
                s -= math.log10(256 - len(left_out))
        out.append(s)
    return out


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
