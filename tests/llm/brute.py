"""Plain versions of the operators, row by row, to hold them against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "[\x20\x09-\x0d]"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    """docs: (id, text) -> sorted rows (id, keep, size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(f"{SPACE}+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, sha(norm)) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def line_dedup(docs, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    first, holders = {}, defaultdict(set)
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                holders[k].add(order(i))
                first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) > 1 and first[key(x)] != order(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def simhash_groups(docs):
    fps = defaultdict(list)
    for i, t in docs:
        fps[fingerprint(t)].append(i)
    named = components(list(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for f, ids in fps.items():
        known = [i for i in ids if i is not None]
        if known:
            least[named[f]] = min([*known, *([least[named[f]]] if named[f] in least else [])])
    return sorted(((i, f, least.get(named[f])) for f, ids in fps.items() for i in ids), key=str)


def word_runs(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar_groups(docs, n=5, least=0.8):
    """{id: smallest id linked by Jaccard similarity of word runs, step by step}; ids differ."""
    sets = {i: word_runs(t, n) for i, t in docs}
    linked = lambda a, b: bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    return components(list(sets), linked)


def contaminated(docs, bench, width=10):
    """(id, n_words, n_hit, items)."""
    windows = defaultdict(set)
    for item, text in bench:
        words = WORD.findall((text or "").translate(UP))
        k = min(width, len(words))
        for p in range(len(words) - k + 1 if words else 0):
            windows[tuple(words[p : p + k])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        words = WORD.findall((t or "").translate(UP))
        hit, items = set(), set()
        for p in range(len(words)):
            for k in sizes:
                w = tuple(words[p : p + k])
                if len(w) == k and w in windows:
                    hit |= set(range(p, p + k))
                    items |= windows[w]
        out.append((i, len(words), len(hit), sorted(items)))
    return sorted(out, key=str)


def phrases(text, known):
    """Phrases of greedy longest matches against a text; a symbol not in it is a phrase of its own."""
    n = p = 0
    while p < len(text):
        k = 1
        while p + k <= len(text) and text[p : p + k] in known:
            k += 1
        p += max(1, k - 1)
        n += 1
    return n
