"""Slow, plain versions of what the operators compute."""

import re


def shingles(text, words=5):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(own) < words:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(tuple(own[i : i + words]) for i in range(len(own) - words + 1))


def components(nodes, linked):
    """The least node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(rows):
    """doc_id: (set size, component) of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((a, b))
    named = components(ids, links)
    return {i: (len(sets[i]), named[i]) for i in ids}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variant(draw, words, rate, vocabulary):
    """The words, some of them replaced, dropped or doubled."""
    out = []
    for w in words:
        if draw.random() >= rate:
            out.append(w)
        else:
            out += draw.choice([[], [draw.choice(vocabulary)], [w, w]])
    return out
