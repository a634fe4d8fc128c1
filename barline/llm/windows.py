"""Repeated fixed-length windows over whole texts: the part that both substring operators share.

Every window of `length` tokens chooses one anchor (a `k`-token sub-window, chosen by
content alone), and consecutive windows with the same anchor form one block. Equal
windows have equal anchors, so only blocks whose anchor repeats can hold a repeated
window. Blocks that are equal as a whole are settled at once; what is left is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import NO_HASH, anchors, as_long, byte_lanes, mix, span_hash, text_chunks, token_rows, Words, window_hash
from .shared import in_sketch, repeated_sketch, save

BLOCKS = "anchor long, block long, doc_key long, part long, lo int, n int, again boolean"


def tokens(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash lanes and row offsets of the tokens: words or bytes."""
    if unit == "byte":
        return byte_lanes(data), offsets
    words = Words(data, offsets)
    return words.lanes, words.row_offsets


def place_hash(doc_key: np.ndarray, part: np.ndarray, lo: np.ndarray | int = 0) -> np.ndarray:
    """Hash of a place in a document, for sketches of places."""
    return mix(mix(mix(doc_key.view(np.uint64)) + part.view(np.uint64)) + np.asarray(lo).astype(np.uint64))


def home_hash(anchor: np.ndarray, doc_key: np.ndarray) -> np.ndarray:
    """Hash of an anchor in a document, for sketches of all its places there."""
    return mix(mix(doc_key.view(np.uint64)) + anchor)


def home_sketch(blocks: DataFrame) -> np.ndarray:
    """repeated_sketch of the pairs (anchor, doc_key) of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, key = (batch.column(i).to_numpy() for i in range(2))
            yield pa.record_batch([as_long(home_hash(anchor.view(np.uint64), key))], names=["id"])

    return repeated_sketch(blocks.select("anchor", "doc_key").mapInArrow(run, "id long"), "id")


def place_sketch(places: DataFrame, at: str | None = None) -> np.ndarray:
    """repeated_sketch of the places (doc_key, part, and the column `at`) of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, part, *lo = (batch.column(i).to_numpy() for i in range(batch.num_columns))
            yield pa.record_batch([as_long(place_hash(key, part, *lo))], names=["id"])

    columns = ["doc_key", "part", *([at] if at else [])]
    return repeated_sketch(places.select(*columns).mapInArrow(run, "id long"), "id")


def chosen_texts(batch: pa.RecordBatch, only: np.ndarray | None) -> pa.RecordBatch:
    """The rows of a batch whose (doc_key, part) may be in a sketch; all without one."""
    if only is None or not len(batch):
        return batch
    keep = in_sketch(only, place_hash(batch.column("doc_key").to_numpy(), batch.column("part").to_numpy()))
    return batch.filter(pa.array(keep))


def anchor_hashes(docs: DataFrame, unit: str, k: int, length: int, only=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(chosen_texts(batch, only and only.value).column("text")):
                (lane, *_), rows = tokens(unit, data, offsets)
                yield pa.record_batch([as_long(anchors(lane, rows, k, length)[1])], names=["anchor"])

    return docs.select("doc_key", "part", "text").mapInArrow(run, "anchor long")


@dataclass
class Chunk:
    """Blocks of a chunk of texts that a sketch lets through (row indices are within the chunk)."""

    lanes: list[np.ndarray]
    rows: np.ndarray
    data: np.ndarray
    row: np.ndarray
    anchor: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc_key: np.ndarray
    part: np.ndarray


def scan_blocks(batches: Iterator[pa.RecordBatch], unit: str, k: int, length: int, sketch: np.ndarray, by: str, only: np.ndarray | None = None) -> Iterator[Chunk]:
    """Blocks of doc_key, part, text batches whose anchor, place or home (anchor and document) is in the sketch."""
    for whole in batches:
        batch = chosen_texts(whole, only)
        keys, parts = batch.column("doc_key").to_numpy(), batch.column("part").to_numpy()
        for i, _, data, offsets in text_chunks(batch.column("text")):
            lanes, rows = tokens(unit, data, offsets)
            at, h, lo, hi = anchors(lanes[0], rows, k, length)
            row = token_rows(rows)[at] if len(at) else at
            if by == "anchor":
                hit = in_sketch(sketch, h)
            elif by == "home":
                hit = in_sketch(sketch, home_hash(h, keys[i + row]))
            else:
                hit = in_sketch(sketch, place_hash(keys[i + row], parts[i + row], lo - rows[row]))
            if hit.any():
                row = row[hit]
                yield Chunk(lanes, rows, data, row, h[hit], at[hit], lo[hit], hi[hit], keys[i + row], parts[i + row])


def candidate_blocks(docs: DataFrame, unit: str, k: int, length: int, doubled: bool = False, only: np.ndarray | None = None) -> DataFrame:
    """Blocks whose anchor occurs at least twice anywhere (and a few more: see repeated_sketch).

    `lo` is the first window start and `n` the number of windows; `again` tells blocks that
    their text holds further in front (a text that repeats itself is no hot key then). With
    `doubled`, `left` and `right` hash the anchor at twice its length, extended to either side
    (null past the text's edge). `only` is a sketch of the rows to look at.
    """
    context = docs.sparkSession.sparkContext
    rows_only = context.broadcast(only) if only is not None else None
    counts = anchor_hashes(docs, unit, k, length, rows_only).groupBy("anchor").agg(F.count("*").alias("n"))
    sketch = context.broadcast(repeated_sketch(counts.filter("n > 1"), "anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in scan_blocks(batches, unit, k, length, sketch.value, "anchor", rows_only and rows_only.value):
            start, end = c.rows[c.row], c.rows[c.row + 1]
            block = span_hash(c.lanes[1], c.lo, c.hi + length)
            order = np.lexsort((c.lo, block, c.anchor, c.row))
            a, b = order[1:], order[:-1]
            again = np.zeros(len(order), dtype=bool)
            again[a] = (c.row[a] == c.row[b]) & (c.anchor[a] == c.anchor[b]) & (block[a] == block[b])
            columns = {"anchor": as_long(c.anchor), "block": as_long(block), "doc_key": pa.array(c.doc_key), "part": pa.array(c.part), "lo": pa.array((c.lo - start).astype(np.int32)), "n": pa.array((c.hi - c.lo + 1).astype(np.int32)), "again": pa.array(again)}
            if doubled:
                double = window_hash(c.lanes[0], 2 * k)
                for name, p in (("left", c.at - k), ("right", c.at)):
                    ok = (p >= start) & (p + 2 * k <= end)
                    side = np.full(len(p), NO_HASH, dtype=np.uint64)
                    side[ok] = double[p[ok]]
                    columns[name] = pa.array(side.view(np.int64), mask=~ok)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return save(docs.select("doc_key", "part", "text").mapInArrow(run, BLOCKS + (", left long, right long" if doubled else "")), "blocks")


def settle_blocks(blocks: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first holder of each distinct block, blocks that an earlier holder covers whole).

    `order` names the columns that say what "earlier" means. Holders are counted with partial
    aggregation and the firsts are written, so that the join back to the holders is one that
    Spark can split where a third of the documents share a block.
    """
    first = F.min(F.struct(*order, *[c for c in ("part", "lo", "left", "right") if c in blocks.columns and c not in order]))
    firsts = save(blocks.groupBy("anchor", "block").agg(first.alias("first"), F.count("*").alias("holders")).select("anchor", "block", "first.*", "holders"), "firsts")
    earliest = firsts.filter("holders > 1").select("anchor", "block", F.struct(*order).alias("earliest"))
    covered = blocks.join(earliest, ["anchor", "block"]).filter(F.struct(*order) > F.col("earliest"))
    return firsts, covered.select("doc_key", "part", "lo", "n")


def let_through(df: DataFrame, columns: list[str], sketch: np.ndarray) -> DataFrame:
    """The rows of which any of the (long, maybe null) columns may be in a sketch. Joining on
    such a column would gather a frequent value in one task; this is a filter."""
    held = df.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(len(batch), dtype=bool)
            for c in columns:
                column = batch.column(batch.schema.names.index(c))
                known = np.asarray(column.is_valid())
                hit |= known & in_sketch(held.value, column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit))

    return df.mapInArrow(run, df.schema)


def open_blocks(firsts: DataFrame) -> DataFrame:
    """First holders whose anchor also occurs in a different block (and a few more): only these
    can still repeat a window in part."""
    rivals = firsts.groupBy("anchor").agg(F.count("*").alias("rivals")).filter("rivals > 1")
    return let_through(firsts, ["anchor"], repeated_sketch(rivals, "anchor"))


def span_mask(spans, n: int) -> np.ndarray:
    """True for the tokens covered by any of the spans."""
    if spans is None or not len(spans):
        return np.zeros(n, dtype=bool)
    edges = np.zeros(n + 1, dtype=np.int64)
    lo, hi = (np.asarray(spans.field(x)) for x in (0, 1))
    np.add.at(edges, lo, 1)
    np.add.at(edges, np.minimum(hi, n), -1)
    return np.cumsum(edges[:-1]) > 0


def per_document(docs: DataFrame, spans: DataFrame, schema: str, row: Callable) -> DataFrame:
    """row(doc_id, utf-8 bytes, spans) -> tuple, for every document with its spans (lo, hi).

    Only documents that a sketch of the spans' places lets through are shuffled to their spans
    (whose number is bounded by the document's length); all others are settled in the scan.
    """
    names = [x.split()[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in schema.split(",")]
    spans = save(spans.select("doc_key", "part", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")), "spans")
    touched = docs.sparkSession.sparkContext.broadcast(place_sketch(spans.select("doc_key", "part").distinct()))

    def hit(batch: pa.RecordBatch) -> np.ndarray:
        return in_sketch(touched.value, place_hash(batch.column("doc_key").to_numpy(), batch.column("part").to_numpy()))

    def rows(batch: pa.RecordBatch, lists: pa.Array | None) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
        for a in range(0, len(ids), 500):
            out = [row(ids[i], texts[i].as_py() or b"", lists[i].values if lists is not None and lists[i].is_valid else None) for i in range(a, min(a + 500, len(ids)))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows(batch.filter(pa.array(~hit(batch))), None)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hit(batch)))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows(batch, batch.column("spans"))

    lists = spans.groupBy("doc_key", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    few = docs.mapInArrow(chosen, docs.schema).join(lists, ["doc_key", "part"], "left").select("doc_id", "text", "spans")
    return docs.mapInArrow(untouched, schema).unionByName(few.mapInArrow(settled, schema))
