import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barline.llm import near_dup, suffix
from barline.llm.components import components
from barline.llm.decontaminate import contaminated
from barline.llm.near_dup import densified, keep_first, near_duplicates, shingle_sets
from barline.llm.sequences import CHUNK_BYTES, anchors, text_chunks, window_hash
from barline.llm.shared import keyed
from barline.llm.substring import substring_dedup
from barline.llm.suffix import multikey_quicksort, suffix_array_dedup

from . import brute

SCHEMA = "doc_id long, text string"


def corpus(seed=3, n=60):
    """Random texts with shared passages, copies, edits, and short, long, empty and null texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    texts = []
    for i in range(n):
        body = [word() for _ in range(r.choice([3, 40, 120, 200]))]
        if i % 3 == 0:
            body.insert(r.randint(0, len(body)), passage)
        texts.append(r.choice([" ", "\n", "  "]).join(body))
        if i % 5 == 4:
            edited = texts[-2].split(" ")
            edited[len(edited) // 2] = "X"
            texts[-1] = " ".join(edited)
        if i % 7 == 6:
            texts[-1] = texts[-3]
    texts += ["", None, "a", "ab " * 400, "z" * 500, "one two three four", "one two three four", "ONE two three four"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("n_words", F.lit("clash")).withColumn("lo", F.lit(1))


def test_substring(spark, rows):
    got = sorted(tuple(r)[:4] for r in substring_dedup(frame(spark, rows)).collect())
    assert got == brute.substring(rows)


def test_substring_in_doubled_documents(spark):
    """A passage twice in one document (or in two rows of its id) that also starts in a smaller id."""
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 60, 6):
        passage = words(60)
        section = words(30) + passage + words(30)
        rows.append((i, " ".join(words(20) + passage + words(20))))
        rows.append((i + 2, " ".join(section + words(25) + section)))
        rows += [(i + 4, " ".join(words(9) + section)), (i + 4, " ".join(section + words(8)))]
    got = sorted(tuple(x)[:4] for x in substring_dedup(frame(spark, rows)).collect())
    assert got == brute.substring(rows)
    assert sum(x[2] for x in got if x[0] % 6 == 2) == 10 * 120


def test_substring_of_other_lengths(spark, rows):
    for length in (7, 20):
        assert sorted(tuple(r)[:4] for r in substring_dedup(frame(spark, rows), length).collect()) == brute.substring(rows, length)


@pytest.mark.parametrize("size,width", [(150_000, 16), (5, 16), (5, 1), (40, 77)])
def test_suffix(spark, rows, size, width, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_SLICES", size)  # few and many boundaries
    monkeypatch.setattr(suffix, "SLICE", width)
    got = sorted(tuple(r)[:5] for r in suffix_array_dedup(frame(spark, rows)).collect())
    assert got == brute.suffix(rows)


def test_near(spark, rows):
    for percent in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), percent / 100).collect()}
        assert got == brute.near(rows, percent)


def test_buckets_miss_few_pairs_of_any_size():
    """Pairs just at the threshold share a bucket but for about one in a thousand, short sets as well as long ones."""
    rng = np.random.default_rng(0)
    bands = near_dup.bands_for(0.85, 6)
    for n, times in ((7, 4000), (14, 4000), (30, 3000), (100, 1500), (400, 600)):
        sets = []
        for _ in range(times):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            sets += [x, x[: -(-n * 85 // 100)]]
        sig = densified(sets, 6 * bands).reshape(-1, bands, 6)
        assert (sig[0::2] == sig[1::2]).all(axis=2).any(axis=1).mean() > 0.997


def test_near_of_dealt_groups(spark, monkeypatch):
    """A centre of many pairs and a frequent shingle, dealt to many tasks."""
    monkeypatch.setattr(near_dup, "SPOKES", 3)
    r = random.Random(18)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(frame(spark, rows), 0.85).collect()}
    assert got == brute.near(rows, 85)


def test_texts_that_repeat_themselves(spark):
    unit = "abcdefg, hijk. "
    rows = [(1, unit * 60 + "end"), (2, "x" * 500), (3, "start " + unit * 40), (4, "a b " * 90), (5, "x" * 700 + unit * 9)]
    assert sorted(tuple(r)[:5] for r in suffix_array_dedup(frame(spark, rows)).collect()) == brute.suffix(rows)
    assert sorted(tuple(r)[:4] for r in substring_dedup(frame(spark, rows)).collect()) == brute.substring(rows)


def test_very_long_texts(spark):
    """Texts beyond the bytes that are looked at together, with passages that repeat in them."""
    r = random.Random(31)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = words(80)
    long = words(150_000) + " " + passage + " " + words(150_000)
    assert len(long) > CHUNK_BYTES
    rows = [(1, long), (2, "start " + passage + " end"), (3, passage + " " + long), (4, long + " one more")]
    sub = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup(frame(spark, rows)).collect()}
    assert sub == {1: (300_080, 0), 2: (82, 80), 3: (300_160, 300_160), 4: (300_082, 300_080)}
    suf = {x.doc_id: (x.n_bytes, x.n_removed) for x in suffix_array_dedup(frame(spark, rows)).collect()}
    size = {d: len(t) for d, t in rows}
    assert suf[1] == (size[1], 0) and suf[4] == (size[4], len(long)) and suf[3][1] >= size[3] - 2
    near = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows)).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 1}
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert sorted(x.doc_id for x in contaminated(frame(spark, rows), bench).collect()) == [1, 2, 3, 4]


def test_near_chain(spark):
    """Links that pass only through a member that is not the centre of its bucket."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(8):
        rows.append((i, " ".join(base)))
        base[7 * i] = f"x{i}"
    rows = [(d, t) for d, t in zip((5, 0, 3, 6, 1, 7, 2, 4), (t for _, t in rows))]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), 0.8).collect()}
    assert got == {d: c for d, (_, c) in brute.near(rows, 80).items()}


@pytest.mark.parametrize("stars", [1, 2])
def test_near_cluster(spark, stars, monkeypatch):
    """Copies of one text with 0 to 5 edits each: similarities lie on both sides of the threshold."""
    monkeypatch.setattr(near_dup, "STARS", stars)
    r = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["new"], [words[at], words[at]]])
        rows.append((i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(frame(spark, rows), 0.85).collect()}
    assert got == brute.near(rows, 85)


@pytest.mark.parametrize("size", [150_000, 3])
def test_suffix_of_many_null_ids(spark, size, monkeypatch):
    """Rows without an id are documents of their own, in the order of their texts' hashes; with small
    buckets a passage that all of them hold is compared across boundaries."""
    monkeypatch.setattr(suffix, "BUCKET_SLICES", size)
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(160)
    texts = [noise(80) + passage + noise(80) for _ in range(20)]
    ordered = [x.text for x in spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text")).collect()]
    got = sorted(tuple(x)[1:5] for x in suffix_array_dedup(frame(spark, [(None, t) for t in texts])).collect())
    assert got == sorted(x[1:] for x in brute.suffix(list(enumerate(ordered))))


def test_rows_without_id_are_told_apart(spark):
    """20,000 texts under null ids have as many keys (a 16-bit hash of the text left fewer)."""
    texts = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert keyed(texts).select("doc_key", "part").distinct().count() == 20_000


def test_prefix_pairs_of_repeated_rows(spark):
    """Similar pairs of which one row is repeated, or has a text of equal size under its id."""
    r = random.Random(2)
    rows, nodes, want = [], [], set()
    for i in range(0, 80, 2):
        words = [f"w{r.randrange(10**6)}" for _ in range(79)]
        near = list(words)
        near[r.choice([1, 77])] = "x"  # 2 of 75 shingles differ
        near[r.choice([3, 75])] = "y"
        rows += [(i, " ".join(words)), (i + 1, " ".join(near))]
        rows.append(rows[-2] if i % 4 else (i, " ".join(f"v{r.randrange(10**6)}" for _ in range(79))))
        nodes += [(i, i), (i + 1, i + 1)]
        a, b = brute.shingles(" ".join(words)), brute.shingles(" ".join(near))
        if 100 * len(a & b) >= 85 * len(a | b):
            want.add((i, i + 1))
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = near_dup.rare_prefix_pairs(texts, spark.createDataFrame(nodes, "node long, component long"), 5, 85)
    assert len(want) > 20 and {(x.a, x.b) for x in pairs.collect()} >= want


def test_repeated_and_null_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, other), (2, text), (None, text), (None, other), (3, None), (None, None)]
    df = frame(spark, rows)
    sub = sorted(((r.doc_id or 99, r.n_words, r.n_removed) for r in substring_dedup(df).collect()))
    assert sub == [(1, 80, 0)] * 3 + [(2, 80, 80), (3, 0, 0), (99, 0, 0), (99, 80, 80), (99, 80, 80)]
    suf = sorted((r.doc_id or 99, r.n_removed > 0) for r in suffix_array_dedup(df).collect())
    assert suf == [(1, False)] * 3 + [(2, True), (3, False), (99, False), (99, True), (99, True)]
    near = sorted(((r.doc_id or 99, r.component_id or 99, r.kept) for r in near_duplicates(df).collect()))
    assert near == [(1, 1, True)] * 3 + [(2, 1, False), (3, 3, True), (99, 1, False), (99, 1, False), (99, 99, True)]
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 99 for r in kept.collect()) == [1, 3, 99]


def test_empty_tables(spark):
    df = frame(spark, [(1, "a")]).filter("false")
    for out in (substring_dedup(df), suffix_array_dedup(df), near_duplicates(df), keep_first(df)):
        assert out.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == 0 and got[201] == got[202] == 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(2, 6), st.integers(0, 6))
def test_anchors_are_local(values, k, more):
    """Every window chooses one anchor inside it, and equal windows choose equal offsets."""
    length = k + more
    lane = np.array([(v + 1) * 0x9E3779B97F4A7C15 % 2**64 for v in values], dtype=np.uint64)
    at, _, lo, hi = anchors(lane, np.array([0, len(values)]), k, length)
    offset = {}
    covered = []
    for p, a, b in zip(at, lo, hi):
        for s in range(a, b + 1):
            covered.append(s)
            assert s <= p <= s + length - k
            assert offset.setdefault(tuple(values[s : s + length]), p - s) == p - s
    assert covered == list(range(max(0, len(values) - length + 1)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=60))
def test_multikey_quicksort(rows):
    keys = np.array(rows, dtype=np.uint64).reshape(-1, 2)
    assert keys[multikey_quicksort(keys)].tolist() == sorted(map(list, rows))


def test_multikey_quicksort_splits():
    keys = np.random.default_rng(1).integers(0, 5, size=(20_000, 3)).astype(np.uint64)
    assert keys[multikey_quicksort(keys)].tolist() == sorted(keys.tolist())


def test_chunks_hold_whole_texts():
    import pyarrow as pa

    texts = ["", None, "ab c", "é" * 50, "x"]
    got = []
    for i, j, data, offsets in text_chunks(pa.array(texts).slice(0), limit=20):
        got += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert len(offsets) == j - i + 1
    assert got == [t or "" for t in texts]
    assert len(window_hash(np.zeros(3, np.uint64), 5)) == 0


def test_densification_estimates_similarity():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
    sig = densified([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b])), common[:1]], 600)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.1 and (sig[2] == sig[2][0]).all()


def test_shingles_match_brute_force():
    import pyarrow as pa

    texts = ["a B c d e f", "a b", "", "A b", "x y z v w"]
    (_, _, data, offsets), = text_chunks(pa.array(texts))
    sets = shingle_sets(data, offsets, 5)
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts] and sets[1].tolist() == sets[3].tolist()


def test_equal_rows_make_no_hot_bucket(spark, monkeypatch):
    """Thousands of equal rows of one id, with a passage that other documents hold too: sliced once."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = [(5, "start " + passage + " end")] * 3000 + [(1, "one " + passage), (9, passage + " nine")] * 2
    made = []
    slices = suffix._slices
    monkeypatch.setattr(suffix, "_slices", lambda *a: made.append(slices(*a)) or made[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_array_dedup(df).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.n_removed) for x in got} == {(1, 0), (5, 151), (9, 151)}  # with the space beside it
    assert made[0].count() < 100


def test_suffix_dedup_scans_no_text_after_it_returns(spark):
    """The last scan runs under the operator's own limits, which are gone afterwards."""
    rows = [(i, "the same passage of some length, " * 8 + str(i % 3), "s") for i in range(20)]
    got = suffix.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 20
    assert not any(spark.conf.get(f"spark.sql.{x}", None) for x in ("execution.arrow.maxBytesPerBatch", "adaptive.advisoryPartitionSizeInBytes"))
