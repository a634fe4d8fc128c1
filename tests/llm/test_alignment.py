"""Cross-tokenizer alignment against whole-text encoding and sets of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barline.llm import alignment
from barline.llm.queries import QUERIES, table

DATA = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "a", "word", "  two  spaces ", "line\nline \n next\t tab \n", "▁ literal", "<s> </s> <|endoftext|> <0x41>", "naïve café – 10,000 €", "日本語 テスト 漢字",
    "👩‍👩‍👧 emoji", "Ａ full width", "é accent", "\x00 nul \x1c sep   nbsp   em", "x" * 3000, " " * 500, "don't we'll I'm", "a  b   c    d", "\n\n", "word", "tail space \n ",
]


def brute(texts):
    t = alignment.load(alignment.TOKENIZERS)
    each = []
    for text in texts:
        text = text or ""
        a = t.byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.piece.encode(text) if text else []
        whole = (" " + text).encode()
        if b"".join(t.a_bytes[i] for i in a) != whole or b"".join(t.b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(x[i]) for i in ids], dtype=int).tolist() for ids, x in ((a, t.a_bytes), (b, t.b_bytes))]
        each.append((a, b, [(x, y) for x, p in zip(a, ends[0]) for y in [dict(zip(ends[1], b)).get(p)] if y is not None] if len(a) < 300 else links_of(a, b, ends), ends))
    count = Counter(link for _, _, links, _ in each for link in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for a, b, links, ends in each:
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for p in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if last < e <= p) for ids, es in ((a, ends[0]), (b, ends[1]))))
            last = p
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(common), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


def links_of(a, b, ends):
    at = dict(zip(ends[1], b))
    return [(x, at[p]) for x, p in zip(a, ends[0]) if p in at]


def test_forms_against_brute_force(spark):
    rows = [(i if i != 3 else None, t, "x", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in alignment.align_documents(df).collect()}
    assert got == {r[0]: x for r, x in zip(rows, brute(TEXTS))}
    assert got[0] == got[1] == got[7] == (0, 0, 0, 0, 0, 0, "")


def test_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, DATA, "documents").collect())
    got = [tuple(r)[1:] for r in sorted(QUERIES["op11_align_tokenizers"](spark, DATA).collect())]
    assert got == brute([t for _, t in docs])


def test_token_lists_and_overlaps(spark):
    texts = [t for t in TEXTS if t and "▁" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = alignment.load(alignment.TOKENIZERS)
    for r in alignment.align_tokens(df).collect():
        whole = (" " + texts[r.doc_id]).encode()
        assert b"".join(t.a_bytes[i] for i in r.a_ids) == b"".join(t.b_bytes[i] for i in r.b_ids) == whole
        ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for ids, x in ((r.a_ids, t.a_bytes), (r.b_ids, t.b_bytes))]
        assert [ends[0][i - 1] for i in r.a_stops] == [ends[1][i - 1] for i in r.b_stops] == sorted(set(ends[0]) & set(ends[1]))
        for i, (first, last) in enumerate(zip(r.a_first, r.a_last)):
            start, end = (ends[0][i - 1] if i else 0), ends[0][i]
            want = [j for j, e in enumerate(ends[1]) if e > start and (ends[1][j - 1] if j else 0) < end]
            assert [first, last] == [want[0], want[-1]]


@pytest.mark.parametrize("seed", range(20))
def test_gallop(seed):
    random.seed(seed)
    size = random.choice([10, 3000, 40_000])
    a, b = (np.array(sorted(random.sample(range(1, size * 2), random.randint(1, size)))) for _ in range(2))
    at_a, at_b = alignment.common_ends(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[at_a].tolist() == b[at_b].tolist() == common


def test_long_text_empty_table_and_repeats(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["lorem ", "ip\n", "éa ", "x", "1234 "]) for _ in range(600_000))
    assert len(long) > 2_000_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "y" * 50_000)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in alignment.align_documents(df).collect())
    t = alignment.load(alignment.TOKENIZERS)
    assert rows[0] == rows[1] and rows[0][1:3] == (len(t.byte.encode(" " + long).ids), len(t.piece.encode(long)))
    assert alignment.align_documents(df.limit(0)).count() == 0
