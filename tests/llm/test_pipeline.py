import math
import random

import pytest
from pyspark.sql import functions as F

from barline.llm.decontaminate import contaminated
from barline.llm.mixing import target_words

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A small corpus with copies, near copies, leaked items, junk and a null row, on disk."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, line(20)) for i in range(4)]
    rows = []
    for i in range(120):
        text = "\n".join(line(r.randint(8, 20)) for _ in range(r.randint(4, 9)))
        if i % 10 == 1:
            text = rows[-1][1]
        if i % 10 == 2:
            text = rows[-2][1] + " end."
        if i % 10 == 3:
            text += "\n" + items[i % 4][1]
        if i % 10 == 4:
            text = " | ".join(word() for _ in range(60))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows.append((200, None, None, None, None))
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, items


def test_run_against_brute_force(spark, data):
    root, rows, items = data
    good = [(d, brute.quality(t)[3], s) for d, t, _, s, _ in rows if brute.quality(t)[0]]
    near = brute.near([(d, t) for d, t, _ in good], 80)
    kept = [(d, t, s) for d, t, s in good if near[d][1] == d]

    def leaks(text):
        words = text.lower().split()
        return any(brute.smith_waterman(words, item.lower().split()) >= 0.5 for _, item in items)

    clean = [(d, t, s) for d, t, s in kept if not leaks(t)]
    assert 0 < len(clean) < len(kept) < len(good) < len(rows)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for (name, stage), want in zip(pipeline.STAGES, (good, kept, clean)):  # the first three exactly
        docs = stage(spark, docs, root)
        assert sorted((r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()) == sorted((d, t, s, len(t)) for d, t, s in want), name
    out = pipeline.run(spark, root).collect()
    assert {r.doc_id for r in out} <= {d for d, _, _ in clean}
    size = {d: len(t.split()) for d, t, _ in clean}
    sources = sorted({s for _, _, s in clean})
    sizes = {s: sum(size[d] for d, _, x in clean if x == s) for s in sources}
    for s, target in target_words(sizes, dict(zip(sources, (3.0, 1.0, 2.0))), 1.5, 2).items():
        assert abs(sum(size[r.doc_id] for r in out if r.source == s) - target) <= max(size.values())
    assert all(0 <= r.shard < 40 for r in out)
    assert sorted(map(str, out)) == sorted(map(str, pipeline.run(spark, root).collect()))
    assert math.isclose(sum(sizes.values()), sum(size.values()))


def test_stages_keep_columns_and_bear_odd_rows(spark, data):
    root, _, _ = data
    names = "size times n h rest cut full fit shard text_hash edge before w bin pattern source_size row unit spans lo part".split()
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 5000, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("clash") for n in names})
    for frame in (docs, docs.filter("false")):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, frame, root).columns == docs.columns
        last = pipeline.STAGES[-1][1](spark, frame, root)
        assert last.count() == frame.count() and [c for c in last.columns if c != "shard"] == [c for c in docs.columns if c != "shard"]
    assert contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() >= 0
