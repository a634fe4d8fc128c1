"""Substring deduplication over words, by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length: anchors of 13
words that occur once are out; of the rest, blocks that are equal as a whole are settled,
and the others must repeat at 26 words to either side before their 50-word windows are
compared at all. No level looks at a window that failed the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import as_long, window_hash
from .shared import keyed, repeated_sketch, save
from .windows import candidate_blocks, home_sketch, let_through, open_blocks, per_document, scan_blocks, settle_blocks, span_mask


def doubled(blocks: DataFrame) -> DataFrame:
    """The open blocks of which a doubled anchor, to the left or to the right, repeats."""
    sides = blocks.select(F.explode(F.array("left", "right")).alias("side")).filter("side IS NOT NULL")
    twice = sides.groupBy("side").agg(F.count("*").alias("times")).filter("times > 1")
    return let_through(blocks, ["left", "right"], repeated_sketch(twice, "side"))


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """Word spans (doc_key, part, lo, hi) of all windows of `length` words that also start in
    a document with a smaller id. `docs` comes from `keyed`."""
    k = -(-length // 4)
    blocks = candidate_blocks(docs, "word", k, length, doubled=True)
    firsts, covered = settle_blocks(blocks, ["doc_key"])
    # A document can hold its open block several times (rows of its id too), and no holder there covers
    # another: all blocks of the anchor in the first holder's document are looked at.
    sketch = docs.sparkSession.sparkContext.broadcast(home_sketch(doubled(save(open_blocks(firsts), "open"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in scan_blocks(batches, "word", k, length, sketch.value, "home"):
            n = c.hi - c.lo + 1
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - c.lo, n)
            w1, w2 = (window_hash(lane, length)[at] for lane in c.lanes)
            yield pa.record_batch([as_long(w1), as_long(w2), pa.array(c.doc_key[of]), pa.array(c.part[of]), pa.array((at - c.rows[c.row[of]]).astype(np.int32))], names=["w1", "w2", "doc_key", "part", "lo"])

    windows = save(docs.select("doc_key", "part", "text").mapInArrow(run, "w1 long, w2 long, doc_key long, part long, lo int"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_key").alias("first"), F.max("doc_key").alias("last"))
    first = save(first.filter("first < last").select("w1", "w2", "first"), "first-windows")
    late = windows.join(first, ["w1", "w2"]).filter("doc_key > first")
    return covered.select("doc_key", "part", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi")).unionByName(
        late.select("doc_key", "part", "lo", (F.col("lo") + length).alias("hi"))
    )


def substring_dedup(documents: DataFrame, length: int = 50) -> DataFrame:
    """Remove every word covered by a `length`-word window that also starts in a document with
    a smaller doc_id, judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space).
    Null or empty text: no words. A null doc_id counts as larger than all ids; rows with one id
    never remove each other's words. Repeated rows are each returned. Extra columns are ignored.
    """
    docs = keyed(documents)

    def row(doc_id, raw, spans):
        words = raw.split()
        gone = span_mask(spans, len(words))
        kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)
        return doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()

    return per_document(docs, repeated_spans(docs, length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", row)
