"""Plain restatements of what the operators must return, for small inputs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def near_duplicates(rows, size=5, threshold=85):
    """rows: list of (id, text), ids may be None or repeat; returns (n, component, kept) of each row."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in words(text)]
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    big = float("inf")
    ids = [big if i is None else i for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), big), ids[k])
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)]
        out.append((i, len(sets[k]), None if c == big else int(c), c == ids[k]))
    return out


def window_repeats(rows, size=50):
    big = float("inf")
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (big if i is None else i):
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def substring_repeats(rows, size=200):
    count = Counter()
    raws = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    for _, raw in raws:
        for k in range(len(raw) - size + 1):
            count[raw[k : k + size]] += 1
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if count[raw[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def base_quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = [False] * len(w)
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            covered[k : k + 3] = [True] * 3
    return len(w), sum(len(x.decode("utf-8", "surrogatepass")) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(covered)


def corpus(n=60, seed=1):
    """Texts with exact copies, near copies, shared passages and odd characters: (id, text)."""
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "ing", "tion", "é", "ßa", "lo", "mi", "ra", "ku"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda k: "".join(word() + rng.choice([" ", " ", " ", "  ", "\n", ". ", "\t"]) for _ in range(k))
    passage = text(80)
    rows = [(i, text(rng.choice([3, 30, 120, 300]))) for i in range(n)]
    for k in range(8):
        rows.append((n + k, rows[k * 3][1]))
    for k in range(8):
        w = rows[k * 2 + 1][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((n + 20 + k, " ".join(w)))
    for k in range(6):
        rows.append((n + 40 + k, text(40) + passage + text(30)))
    rows += [
        (n + 60, None), (n + 61, ""), (n + 62, " \n\t "), (n + 63, "one"), (n + 64, "a b c d"), (n + 65, "A B c D"), (n + 66, "a\u0301 Σ İ 中文 🙂\x00 <|endoftext|> ½ ΟΔΟΣ ﬁ K"), (n + 67, "x" * 500), (n + 68, "spam " * 400),
        (n + 69, " ".join(f"w{k % 977}" for k in range(30000))), (n + 70, text(40) + passage + "\x85\u2028"), (None, text(40)), (None, passage), (5, rows[5][1]), (5, rows[5][1]), (7, "another text of a repeated id " + passage),
    ]
    rng.shuffle(rows)
    return rows
