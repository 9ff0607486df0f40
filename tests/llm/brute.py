"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_counts(text):
    w = words(text)
    windows, covered, seen, repeats = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


def repeats(rows, window):
    """id -> (words, removed, sha256 of the kept words, kept words)"""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def shingles(text, size):
    w = words(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size, percent):
    """id -> (set size, least linked id)"""
    sets = {d: shingles(t, size) for d, t in rows}
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def ngrams(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def backoff(rows, order):
    """A list of (words, score), a row for each of rows."""
    docs = [words(lower(t)) for _, t in rows]
    counts = Counter(g for w in docs for n in range(1, order + 1) for g in ngrams(w, n))
    total, out = sum(map(len, docs)), []
    for w in docs:
        own = Counter(g for n in range(1, order + 1) for g in ngrams(w, n))
        other = lambda g: counts[g] - own[g]  # noqa: B023, E731

        def share(g):
            if len(g) == 1:
                return max(other(g), 0.5) / max(total - len(w), 1)  # noqa: B023
            return other(g) / other(g[:-1]) if other(g) > 0 else 0.4 * share(g[1:])  # noqa: B023

        out.append((len(w), sum(math.log(share(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))))
    return out


def linked(edges):
    """node -> least node of its component"""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(near):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


def style_tree(pages, min_pages, least):
    """Main text of each of a host's pages by a plain style tree. A page is (tag, class, parts), a part such a node or a text."""
    found = []  # by page: path -> (blocks, child tags), the paths in main elements, [(path, block)]

    def walk(node, above, inside, page):
        tag, style, parts = node
        path, inside = (*above, (tag, style)), inside or tag in ("article", "main")
        own = page[0].setdefault(path, ([], []))
        if inside:
            page[1].add(path)
        at = len(page[2])
        for part in parts:
            if isinstance(part, str):
                page[2].append((path, part))
            else:
                own[1].append(part[0])
                walk(part, path, inside, page)
        own[0].extend(t for _, t in page[2][at:])

    for page in pages:
        found.append(({}, set(), []))
        walk(page, (), False, found[-1])
    different = list({tuple(t for _, t in f[2]): f for f in found}.values())
    low = set()
    for path in {p for f in different for p in f[0]}:
        having = [f for f in different if path in f[0]]
        weight = 2 if any(path in f[1] for f in having) else 1
        importance = 0
        for kind in (0, 1):
            shares = [n / len(having) for n in Counter(tuple(f[0][path][kind]) for f in having).values()]
            entropy = -sum(x * math.log(x) for x in shares) / math.log(len(having)) if len(having) > 1 else 1
            importance = max(importance, min(1, weight * entropy))
        if len(having) >= min_pages and importance < least:
            low.add(path)
    return ["\n".join(t for path, t in f[2] if not any(path[:k] in low for k in range(1, len(path) + 1))) for f in found]
