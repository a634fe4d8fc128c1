"""Spelling variants against a plain search of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barline.llm import spelling
from barline.llm.queries import QUERIES, SQL

from ..oracle import rows_of, sql_rows

DATA = "/root/testdata/sf0.001"


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    by_hole = {}
    for w in words:
        for i in range(len(w)):
            by_hole.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    for group in by_hole.values():
        for w in group:
            near[w].update(x for x in group if x != w and len(x) == len(w))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((form[w], words[form[w]] if form[w] else None, n, len(near[w]), root, w))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÀ÷ßz") for _ in range(rng.randint(6, 9))) for _ in range(15)]
    text = []
    for w in base:
        for times in (1000, 90, 7, 2):
            text += [w] * times
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿé") + w[i:], w[:i] + rng.choice("abÿé") + w[i + 1 :]])
    rng.shuffle(text)
    return [(i if i % 7 else None, " ".join(text[i::40]).upper() if i % 3 else "-".join(text[i::40])) for i in range(40)]


@pytest.mark.parametrize("rounds", [1, 3])
def test_forms_against_brute_force(spark, monkeypatch, rounds):
    rows = corpus(rounds) + [(90, None), (91, ""), (92, "short 123 Ālatin")] + [(93, "repeated repeated repeatd")] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    want = brute(rows)
    assert sum(r[0] is not None for r in want) > 10 and any(r[4] not in (r[0], r[5]) for r in want)
    if rounds > 1:
        monkeypatch.setattr(spelling, "ROUND_WORDS", len(want) // 2 - 1)
    columns, got = rows_of(spelling.spelling_variants(df))
    assert columns == ["form", "form_n", "n", "n_near", "root", "word"] and got == want


def test_query_against_sql_and_brute_force(spark):
    got = rows_of(QUERIES["op12_group_spellings"](spark, DATA))
    assert got == sql_rows(DATA, SQL["op12_group_spellings"])
    assert got[1] == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])


def test_very_long_words_and_empty_table(spark):
    long = "".join(random.Random(4).choices("abcdef", k=60_000))
    swapped = long[:1000] + "z" + long[1001:]
    rows = [(i, f"{w} {w}") for i, w in enumerate([long, long[:-1], swapped, long * 34])]
    got = {len(r.word): (r.n_near, r.n) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.word != swapped}
    assert got == {60_000: (2, 2), 59_999: (1, 2), 2_040_000: (0, 2)} or any(zlib.crc32(f"{i}:{w.split()[0]}".encode()) % 31 == 0 for i, w in rows)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_are_exactly_the_neighbourhood():
    """Hashes of edits meet those of words, and each pair of words is met once."""
    words = ["aabbccd", "abbccd", "aabbcce", "aabbccé", "aabccd"]
    by_hash = {}
    for _, at, letters in spelling.by_length(words):
        for i, h in zip(at, spelling.mixed((letters * spelling.powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)).tolist()):
            by_hash[h] = words[i]
    shards = spelling.Shards({6: 2, 7: 3})
    met = Counter()
    for _, at, letters in spelling.by_length(words):
        for _, row, _, _, h in spelling.edits(letters, shards):
            for r, x in zip(row.tolist(), h.tolist()):
                if x in by_hash:
                    met[frozenset((words[at[r]], by_hash[x]))] += 1
    assert met == Counter({frozenset(p): 1 for p in [(words[0], words[1]), (words[0], words[4]), (words[0], words[2]), (words[0], words[3]), (words[1], words[4]), (words[2], words[3])]})
