"""Plain Python statements of what the operators return."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    """Operator 1: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    seen, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            marked |= {i, i + 1, i + 2}
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(v - 1 for v in lines.values()), len(marked), n < 50 or 100 * len(marked) > 50 * n


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def spans(text):
    """Operator 3: base spans as (start, kind, end)."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def span_digest(found):
    names = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return set() if not words else {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def linked(rows):
    """Operator 5: {doc_id: (set size, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def crc(data):
    return zlib.crc32(data)


def repeats_removed(rows, length):
    """Operator 10: {doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if piece in seen:
                gone[p : p + length] = [True] * length
            else:
                seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), kept)
    return out
