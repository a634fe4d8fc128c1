"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def substring(rows, length=50):
    """doc_id -> (n_words, n_removed, sha256)"""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict = {}
    for d, w in words:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < d:
                gone[s : s + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def suffix(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256)"""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def shingles(text, size=5):
    w = (text or "").encode().translate(_LOWER).split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(rows, percent):
    """doc_id -> (n_shingles, component)"""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                continue
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def smith_waterman(passage, item, match=2, mismatch=-1, gap=-1):
    best, prev = 0, [0] * (len(passage) + 1)
    for w in item:
        row = [0]
        for j, p in enumerate(passage, 1):
            row.append(max(0, prev[j - 1] + (match if p == w else mismatch), prev[j] + gap, row[j - 1] + gap))
        best, prev = max(best, *row), row
    return best / (match * len(item))


_WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = r"(?i)\b(all rights reserved|cookie (policy|settings)|accept (all )?cookies|privacy policy|terms (of use|of service|and conditions)|click here|read more|sign (in|up)|log ?in|subscribe (now|to our)|add to cart|share (this|on)|follow us|skip to (main )?content|lorem ipsum|enable javascript|back to top)\b"


def line_fault(line, seen, common=()):
    """The first rule that a line fails, by words and patterns."""
    words = re.findall(_WORD, line)
    if not words:
        return None
    n = len(words)
    if line in seen:
        return "repeated"
    seen.add(line)
    if sum(w in "| » › > / • · :: - – —".split() for w in words) >= max(2, 0.25 * n):
        return "navigation"
    if sum(bool(re.search(r"[#*$%&|<>]{2,}$|!!+$", w)) for w in words) > 0.3 * n:
        return "symbols"
    if n >= 8 and sum(a == b for a, b in zip(words, words[1:])) > 0.3 * n:
        return "stutter"
    if (n <= 12 and re.search(_PHRASES, line)) or (n <= 20 and line in common):
        return "boilerplate"
    if n <= 4 and not re.search(r"""[.!?:;…。！？]['"”’»)\]]*$""", words[-1]):
        return "punctuation"
    if not re.search(r"[^\W\d_]", line):
        return "letters"
    return None


def quality(text, common=()):
    """(kept, lost words, failed rules, clean text); the base verdict included."""
    text = text or ""
    words = re.findall(_WORD, text)
    grams: dict = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    base_failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    seen, lost, clean, faults = set(), 0, [], set()
    for line in text.split("\n"):
        fault = line_fault(line, seen, common)
        if fault:
            lost += len(re.findall(_WORD, line))
            faults.add(fault)
        else:
            clean.append(line)
    kept = not base_failed and 2 * lost <= len(words) and len(words) - lost >= 20
    return kept, lost, ",".join(sorted(faults)), "\n".join(clean)
