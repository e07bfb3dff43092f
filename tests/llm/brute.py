"""Plain versions of the operators on collocations, top-k search and prefix tries."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def collocations(rows, min_count=10, top=2000, max_words=3):
    """`rows` are (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        dropped = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                inner = [p[i : i + m] for i in range(len(p) - m + 1)]
                dropped.update(q for q in inner if 100 * a >= 50 * count[q])
        found = []
        for p in candidates.keys() - dropped:
            a, cuts = count[p], range(1, len(p))
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in cuts)
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def top_k(rows, k=5):
    """`rows` are (id, vector)."""
    kept = []
    for i, (key, vector) in enumerate(rows):
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((i, key, [math.floor(256 * float(x)) for x in vector]))
    out = []
    for i, key, query in kept:
        if key is None or key % 50:
            continue
        scores = sorted(
            (-_long(sum(a * b for a, b in zip(query, vector))), other is None, other or 0, j)
            for j, other, vector in kept
            if j != i and len(vector) == len(query)
        )
        for rank, (score, null, other, _) in enumerate(scores[:k], 1):
            out.append((key, rank, None if null else other, -score))
    return sorted(out, key=repr)


def _long(x):
    return max(-(2**63), min(x, 2**63 - 1))


def prefix_trie(rows):
    """`rows` are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for key, turn, role, text in rows:
        if key is not None:
            own[key].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {key: [turn[2:] for turn in sorted(turns)] for key, turns in own.items()}
    members, length = defaultdict(list), {}
    for key in sorted(own):
        heads = zlib.crc32(str(key).encode()) % 6
        turns = (*own.get(key - key % 100, [])[:heads], *own[key][heads:])
        length[key] = len(turns)
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(key)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, keys in members.items():
        spared = (len(keys) - 1) * len(path[-1][1].decode()) if path else 0
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += not children[path]
            saved[path[:depth]] += spared
    out = []
    for path, keys in members.items():
        ends = ",".join(str(key) for key in keys if length[key] == len(path))
        parent = members[path[:-1]][0] if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        counts = (len(keys), children[path], leaves[path], saved[path])
        out.append((keys[0], len(path), parent, *counts, sha))
    return sorted(out, key=repr)
