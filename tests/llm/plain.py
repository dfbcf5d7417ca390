"""Plain Python forms of the operators' definitions, for small inputs."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10


def words(text, lower=True):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return [w.lower() if lower else w for w in found]  # bytes.lower changes A-Z alone


def shingles(text, width=5):
    w = words(text)
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def near(rows, per_cent=85):
    """doc_id -> (set size, smallest doc_id connected to it)."""
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= per_cent * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, x in enumerate(ids):
        low[root(i)].append(x)
    return {ids[i]: (len(sets[i]), min(low[root(i)])) for i in range(len(ids))}


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, dup, len(covered)


def without_repeats(rows, span=3):
    """doc_id -> (text, lines removed), for rows of different ids."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for k in range(len(full) - span + 1):
            window = tuple(lines[i] for i in full[k : k + span])
            if window in seen:
                gone.update(range(full[k], full[k + span - 1] + 1))
            seen.add(window)
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def base_scores(rows):
    """doc_id -> (held out, tokens, known tokens, training tokens, base score)."""
    counts = Counter()
    for key, text in rows:
        if not held_out(key):
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for key, text in rows:
        tokens = [*words(text), None]
        base = sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out[key] = (held_out(key), len(tokens), sum(counts[t] > 0 for t in tokens), n, base)
    return out
