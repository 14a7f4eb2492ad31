"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def remove_repeats(rows, length):
    first = {}
    words = {i: [] for i, _ in rows}
    for i, t in rows:
        words[i] = w = WORD.findall(t or "")
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def base_scores(rows, held):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score) of the unigram base."""
    from collections import Counter
    from math import log10

    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    count = Counter(w for i, own in tokens.items() if i not in held for w in own)
    total, distinct = sum(count.values()), len(count)
    return {i: (len(own), sum(w in count for w in own), total, sum(log10((count[w] + 1) / (total + distinct + 1)) for w in own)) for i, own in tokens.items()}
