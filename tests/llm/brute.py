"""Plain Python versions of the dealt operators, for small inputs."""

import re
from collections import defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return SPACE_WORD.findall(text.translate(ASCII_LOWER) if lower else text)


def components(nodes, links):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def shingles(text, n):
    w = words(text, lower=True)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_components(rows, n, p, q):
    """rows: id -> text; id -> (set size, component)."""
    sets = {i: shingles(t, n) for i, t in rows.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    label = components(ids, links)
    return {i: (len(sets[i]), label[i]) for i in ids}, len(links)


def remove_repeated(rows, width):
    """rows: id -> text; id -> (words, kept words)."""
    seen, out = set(), {}
    for i in sorted(rows):
        w = words(rows[i])
        gone = set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s:s + width])
            if key in seen:
                gone.update(range(s, s + width))
            seen.add(key)
        out[i] = (w, [x for j, x in enumerate(w) if j not in gone])
    return out


def drop_lines(rows, ratio, min_pages):
    """rows: (host, text) list; kept texts."""
    total, seen = defaultdict(int), defaultdict(int)
    for host, text in rows:
        total[host] += 1
        for line in {x.strip("\t\n\r\x0b\x0c ") for x in (text or "").split("\n")}:
            seen[host, line] += 1
    out = []
    for host, text in rows:
        if text is None or host is None:
            out.append(text)
            continue
        kept = []
        for x in text.split("\n"):
            bare = x.strip("\t\n\r\x0b\x0c ")
            n = seen[host, bare]
            if not (bare and n >= min_pages and n > ratio * total[host]):
                kept.append(x)
        out.append("\n".join(kept))
    return out


def phrases(text, sample):
    """Phrases of a greedy parse of ``text`` against ``sample`` (lists of
    symbols as strings)."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at:at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]
