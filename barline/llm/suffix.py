"""Suffix-array deduplication over UTF-8 bytes.

Candidate suffixes (those whose 24-byte lead repeats) are cut to slices: the suffixes that start
equally far before their lead, up to SLICE neighbours in one row, which all hold the same core
bytes. Spark samples splitters and range-partitions the slices by their core and, inside equal
cores, by their place, so that no frequent lead or core has to fit into one bucket. Each
bucket sorts its slices by multikey quicksort on eight-byte tokens and compares equal suffixes;
groups that touch a bucket's edge are compared across the boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_sketch, keyed, narrow_tasks, save
from .windows import candidate_blocks, open_blocks, per_document, place_hash, place_sketch, scan_blocks, settle_blocks, span_mask

LEAD = 24
#: Suffix starts that share a row: the core of a slice is what all of them hold.
SLICE = 16
#: Slices that a bucket gets about, when Spark samples the splitters.
BUCKET_SLICES = 30_000
_PLACE = "doc_key long, part long, lo int"


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of an (n, d) token matrix: ternary partition on one token at a time,
    ever deeper only inside ranges whose tokens are equal; short ranges are sorted directly."""
    order = np.arange(len(keys))
    stack = [(0, len(keys), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == keys.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= 4096:
            order[lo:hi] = part[np.lexsort(keys[part, depth:].T[::-1])]
            continue
        token = keys[part, depth]
        sample = np.sort(token[:: max(1, len(token) // 63)])
        pivot = sample[len(sample) // 2]
        less, same, more = part[token < pivot], part[token == pivot], part[token > pivot]
        order[lo:hi] = np.concatenate([less, same, more])
        a, b = lo + len(less), lo + len(less) + len(same)
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _tokens(rows: np.ndarray) -> np.ndarray:
    """Big-endian eight-byte tokens of an (n, width) byte matrix, zero-padded."""
    padded = np.zeros((len(rows), max(1, -(-rows.shape[1] // 8)) * 8), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _slices(docs: DataFrame, blocks: DataFrame, length: int, width: int) -> DataFrame:
    """The slices of the open blocks: core, outer (the `width` - 1 bytes on either side of it), side (which
    starts, as their distance to the lead), place of the first possible start, and the starts that are there."""
    sketch = docs.sparkSession.sparkContext.broadcast(place_sketch(blocks, "lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length + width - 1
        for c in scan_blocks(batches, "byte", LEAD, length, sketch.value, "place"):
            near, far = (c.at - c.hi) // width, (c.at - c.lo) // width  # distances of the starts to their lead
            count = far - near + 1
            of = np.repeat(np.arange(len(count)), count)
            side = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - near, count)
            begin = c.at[of] - (side + 1) * width + 1  # of the slice's first possible start
            first, last = np.maximum(c.lo[of], begin) - begin, np.minimum(c.hi[of], begin + width - 1) - begin
            data = np.concatenate([np.zeros(reach, np.uint8), c.data, np.zeros(reach, np.uint8)])
            windows = np.lib.stride_tricks.sliding_window_view(data, reach)
            for a in range(0, len(of), 10_000):
                p = slice(a, a + 10_000)
                rows = windows[begin[p] + reach]
                outer = np.concatenate([rows[:, : width - 1], rows[:, length:]], axis=1)
                own = of[p]
                columns = [_binary(rows[:, width - 1 : length]), _binary(outer), pa.array(side[p].astype(np.int32)), pa.array(c.doc_key[own]), pa.array(c.part[own]), pa.array((begin[p] - c.rows[c.row[own]]).astype(np.int32))]
                yield pa.record_batch([*columns, pa.array(first[p].astype(np.int32)), pa.array(last[p].astype(np.int32))], names=["core", "outer", "side", "doc_key", "part", "lo", "first", "last"])

    return save(docs.select("doc_key", "part", "text").mapInArrow(run, f"core binary, outer binary, side int, {_PLACE}, first int, last int"), "slices")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    whole = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8) if width else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].reshape(len(whole), width)


def _starts(mask: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, n) of the runs of True in the rows of a mask over starts."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    return row, lo[row] + first, last - first


def _sorted_bucket(table: pa.Table, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Runs of starts of a bucket whose suffix also starts earlier in the bucket (`n` starts from
    lo), and the earliest start of every suffix of its first and last group (`window`, n null)."""
    core = _tokens(_matrix(table.column("core"), length - width + 1))
    side, doc, part, lo, first, last = (table.column(c).to_numpy() for c in ("side", "doc_key", "part", "lo", "first", "last"))
    keys = np.column_stack([core, side.astype(np.uint64)])
    order = multikey_quicksort(keys)
    keys = keys[order]
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    edge = (group == 0) | (group == group[-1])
    live = (size[group] > 1) | edge
    order, group, edge = order[live], group[live], edge[live]
    outer = _matrix(table.column("outer"), 2 * width - 2)[order]
    doc, part, lo, first, last = doc[order], part[order], lo[order].astype(np.int64), first[order], last[order]
    late = np.zeros((len(order), width), dtype=bool)
    for j in range(width):
        here = np.flatnonzero((first <= j) & (j <= last))
        if not len(here):
            continue
        around = np.concatenate([outer[here, j : width - 1], outer[here, width - 1 : width - 1 + j]], axis=1)
        tokens = _tokens(around)
        at = np.lexsort((lo[here], part[here], doc[here], *tokens.T[::-1], group[here]))
        rank = np.column_stack([group[here].astype(np.uint64), tokens])[at]
        head = np.append(True, (rank[1:] != rank[:-1]).any(axis=1))
        row = here[at]
        lead = row[np.flatnonzero(head)[np.cumsum(head) - 1]]
        late[row, j] = (doc[row] != doc[lead]) | (part[row] != part[lead]) | (lo[row] != lo[lead])
        heads = row[head & edge[row]]
        if len(heads):
            left, right = outer[heads, j : width - 1], outer[heads, width - 1 : width - 1 + j]
            window = np.concatenate([left, _matrix(table.column("core"), length - width + 1)[order[heads]], right], axis=1)
            yield pa.record_batch([_binary(window), pa.array(doc[heads]), pa.array(part[heads]), pa.array((lo[heads] + j).astype(np.int32)), pa.nulls(len(heads), pa.int32())], names=["window", "doc_key", "part", "lo", "n"])
    row, start, n = _starts(late, lo)
    yield pa.record_batch([pa.nulls(len(row), pa.binary()), pa.array(doc[row]), pa.array(part[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["window", "doc_key", "part", "lo", "n"])


def split_copies(docs: DataFrame) -> tuple[np.ndarray, DataFrame, np.ndarray | None]:
    """(sketch of the rows that hold the first copy of their text, all later copies, sketch of the rows
    that come more than once, None without any). A later copy repeats its first one from end to end, so only first copies
    need suffixes; what the first sketch lets through besides is looked at again and changes nothing."""
    place = F.struct("doc_key", "part")
    texts = save(docs.select("doc_key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes")), "digests")
    first = save(texts.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "first-copies")
    later = texts.join(first.filter("copies > 1").select("digest", "first"), "digest").filter(place > F.col("first"))
    again = save(texts.groupBy("doc_key", "part").count().filter("count > 1").select("doc_key", "part"), "repeated-rows")
    return place_sketch(first.select("first.*")), later.select("doc_key", "part", "n_bytes").distinct(), place_sketch(again) if again.limit(1).count() else None


def once(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """Each (doc_key, part) once. Only rows in the sketch of repeated ones move, one a task and place; equal rows
    would give equal slices, which no splitter can tell apart."""
    sketch = docs.sparkSession.sparkContext.broadcast(repeated)

    @F.pandas_udf("boolean")
    def may_repeat(doc_key, part):
        import pandas as pd

        return pd.Series(in_sketch(sketch.value, place_hash(doc_key.to_numpy(), part.to_numpy())))

    tagged = docs.withColumn("__again", may_repeat("doc_key", "part"))
    moved = tagged.filter("__again").dropDuplicates(["doc_key", "part"])
    return tagged.filter("NOT __again").unionByName(moved).drop("__again")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """Byte spans (doc_key, part, lo, hi) of all `length`-byte strings that also start earlier."""
    width = min(SLICE, length - LEAD + 1)
    first_texts, copies, repeated = split_copies(docs)
    docs = docs if repeated is None else once(docs, repeated)
    blocks = candidate_blocks(docs, "byte", LEAD, length, only=first_texts)
    firsts, covered = settle_blocks(blocks.filter("NOT again"), ["doc_key", "part", "lo"])
    covered = covered.unionByName(blocks.filter("again").select("doc_key", "part", "lo", "n"))
    slices = _slices(docs, open_blocks(firsts), length, width)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(map(len, held)):
            yield from _sorted_bucket(pa.Table.from_batches(held), length, width)

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slices.count() // BUCKET_SLICES)
    dealt = slices.repartitionByRange(parts, "core", "side", "doc_key", "part", "lo")
    found = save(dealt.mapInArrow(buckets, f"window binary, {_PLACE}, n int"), "late")
    place = F.struct("doc_key", "part", "lo")
    heads = found.filter("window IS NOT NULL")
    first = save(heads.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("window", "first"), "boundary")
    across = heads.join(first, "window").filter(place > F.col("first"))
    runs = covered.unionByName(found.filter("window IS NULL").select("doc_key", "part", "lo", "n")).unionByName(across.select("doc_key", "part", "lo", F.lit(1).alias("n")))
    whole = copies.filter(F.col("n_bytes") >= length).select("doc_key", "part", F.lit(0).alias("lo"), F.col("n_bytes").alias("hi"))
    return runs.select("doc_key", "part", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi")).unionByName(whole)


def suffix_array_dedup(documents: DataFrame, length: int = 100) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts earlier (in a
    document with a smaller doc_id, or earlier in the same one), judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start:end of the removed
    runs, comma-joined). Null text counts as empty. A null doc_id counts as larger than all
    ids; rows that share an id but not a text are taken in the order of a hash of their texts.
    Repeated rows are each returned. Extra columns are ignored. The result is written to the shared
    folder like all tables in between, so that the last scan of the texts gets small batches too.
    """
    docs = keyed(documents)

    def row(doc_id, raw, spans):
        gone = span_mask(spans, len(raw))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edge) else raw
        runs = ",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2]))
        return doc_id, len(raw), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), runs

    with narrow_tasks(docs.sparkSession):
        return save(per_document(docs, repeated_spans(docs, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string", row), "judged")
