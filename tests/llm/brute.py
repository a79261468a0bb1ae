"""Plain re-derivations of the operators' contracts for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rows(df):
    return [tuple(r) for r in df.collect()]


def exact(docs):
    groups = defaultdict(list)
    norm = {d: SPACE.sub(" ", t or "") for d, t in docs}
    for d, t in norm.items():
        groups[t].append(d)
    return {(d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}


def substrings(docs, width=20):
    first = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    out = set()
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.add((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, width):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near(docs, width=4, percent=80):
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_gram = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by_gram[g].append(d)
    pairs = {(a, b) for v in by_gram.values() for i, a in enumerate(v) for b in v[:i]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(d, len(s), find(d), d == find(d)) for d, s in sets.items()}


def crc(data):
    return zlib.crc32(data)


def judged(pages, rules, default="allow"):
    """Of (id, url) and (host, path, action): (id, host, path, rule, verdict)."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    out = []
    for page, url in pages:
        rest = url.partition("://")[2] if url else ""
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        fits = []
        for h, p, action in rules:
            h, p = lower(h or ""), p or ""
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h + p), len(h), h + p, action))
        best = max(fits, default=(0, 0, None, default))
        out.append((page, host, path, *best[2:]))
    return out


def merkle(docs, every=7):
    """Of (doc_id, source, lang, n_chars, text): the rows of a verified manifest."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: sha("".join(map(code, row)))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            at = levels[-1]
            levels.append([sha("".join(at[i : i + 2])) for i in range(0, len(at), 2)])
        return levels

    def climb(levels, i, digest):
        siblings = []
        for at in levels[:-1]:
            run = list(at[i - i % 2 : i - i % 2 + 2])
            run[i % 2] = digest
            siblings += [d for k, d in enumerate(run) if k != i % 2]
            digest, i = sha("".join(run)), i // 2
        return digest, siblings

    groups = defaultdict(list)
    for row in docs:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in langs]) if langs else [[]]
    out = []
    for k, g in enumerate(langs):
        for i, row in enumerate(groups[g]):
            shown = list(row)
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % every == 0:
                shown[3] += 1
            digest, siblings = climb(trees[g], i, leaf(shown))
            digest, more = climb(top, k, digest)
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], sha("".join(siblings + more)), digest, digest == top[-1][0]))
    return out


def token_groups(text, a, b):
    """Groups of one text: lists of (ids of A, ids of B); ``a`` and ``b`` give a text's tokens as (id, bytes)."""
    if not text:
        return []
    left, right, whole = a(" " + text), b(text), (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (left, right)):
        return []
    ends = []
    for side in (left, right):
        at, upto = 0, []
        for _, x in side:
            at += len(x)
            upto.append(at)
        ends.append(upto)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = i, j
        while ends[0][i] < cut:
            i += 1
        while ends[1][j] < cut:
            j += 1
        i, j = i + 1, j + 1
        out.append(([t for t, _ in left[p:i]], [t for t, _ in right[q:j]]))
    return out


def alignments(docs, a, b):
    """Of (id, text): the rows of an alignment."""
    grouped = [(d, token_groups(t, a, b)) for d, t in docs]
    linked = [[(x, y) for left, right in g for x in left for y in right] for _, g in grouped]
    count = defaultdict(int)
    for pairs in linked:
        for p in set(pairs):
            count[p] += 1
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (d, g), pairs in zip(grouped, linked, strict=True):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        best = sum(count[p] == most[p[0]] for p in pairs)
        digest = hashlib.sha256(shown.encode()).hexdigest() if g else ""
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(pairs), best, sum(count[p] for p in pairs), digest))
    return out
