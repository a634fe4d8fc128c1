"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded
buckets, and star-shaped candidate edges, confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .sequences import Words, mix, span_hash, text_chunks
from .shared import NO_ID, in_sketch, repeated_sketch, save

_NO_IDS = 1 << 40
#: Stars per bucket before the exact closing takes over.
STARS = 2
#: Pairs of one centre, and holders of one shingle, that a task gets about.
SPOKES = 1000


def node_key() -> Column:
    """doc_id as a node; a null id gets a key above all ids, from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) - F.pmod(F.xxhash64("text"), F.lit(_NO_IDS)))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(node_key().alias("node"), "text")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: `size` words, or all words where fewer."""
    words = Words(data, offsets, lower=True, lanes=1)
    lane, rows = words.lanes[0], words.row_offsets
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    starts = np.repeat(rows[:-1] - begin, count) + np.arange(count.sum())
    ends = np.minimum(starts + size, np.repeat(rows[1:], count))
    h = span_hash(lane, starts, ends)
    return [np.unique(h[a : a + c]) for a, c in zip(begin, count)]


def bands_for(similarity: float, rows: int, miss: float = 1e-4) -> int:
    """Bands so that a pair at the threshold shares no bucket with probability `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def densified(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures: one hash per shingle picks a bin and a value; each empty
    bin copies the first full one on its own random probe sequence (optimal densification)."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    bin_ = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    slot = row.astype(np.uint64) * np.uint64(bins) + bin_
    packed = np.sort((slot << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    slot = packed >> np.uint64(32)
    head = np.append(True, slot[1:] != slot[:-1])
    flat = np.full(len(sets) * bins, empty)
    flat[slot[head].astype(np.int64)] = packed[head] & np.uint64(0xFFFFFFFF)
    raw = flat.reshape(len(sets), bins)
    out = raw.copy()
    at_row, at_bin = np.nonzero(out == empty)
    attempt = 1
    while len(at_row):
        probe = (mix(at_bin.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        value = raw[at_row, probe]
        hit = value != empty
        out[at_row[hit], at_bin[hit]] = value[hit]
        at_row, at_bin = at_row[~hit], at_bin[~hit]
        attempt += 1
    return out


def signatures(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """node, n_shingles, a 128-bit digest of the set and its band buckets (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, size)
                n = np.array([len(s) for s in sets])
                digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
                buckets = np.zeros((len(sets), bands), dtype=np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    sig = densified([sets[x] for x in full], rows * bands).reshape(-1, bands, rows)
                    key = np.broadcast_to(mix(band), sig.shape[:2]).copy()
                    for r in range(rows):
                        key = mix(key * np.uint64(31) + sig[:, :, r])
                    buckets[full] = key.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, bands, 0))).astype(np.int32)), pa.array(buckets[full].ravel()))
                yield pa.record_batch([batch.column("node").slice(i, j - i), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], names=["node", "n_shingles", "d1", "d2", "buckets"])

    return docs.select("node", "text").mapInArrow(run, "node long, n_shingles long, d1 long, d2 long, buckets array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs, by the exact overlap of their shingle sets."""
    texts = docs.select("node", "text")
    # a centre of very many pairs is dealt to one task for every so many of them
    wide = save(pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("k")).filter("k > 1"), "wide-stars")
    dealt = pairs.join(wide, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("k")), F.lit(0)).cast("int").alias("deal"))
    centres = pairs.select("a").distinct().join(wide, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("deal"))
    first = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "deal", F.col("text").alias("text_b"))
    held = centres.join(texts.withColumnRenamed("node", "a"), "a").select("a", "deal", F.col("text").alias("text_a"))
    both = first.join(held, ["a", "deal"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            a, b, text_a = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("text_a")
            linked = np.zeros(len(a), dtype=bool)
            for i, j, data, offsets in text_chunks(batch.column("text_b")):
                sets = shingle_sets(data, offsets, size)
                for r in range(i, j):
                    if held[0] is None or held[0] != a[r] or not held[1].equals(text_a[r]):  # a centre's pairs come together
                        held = (a[r], text_a[r], shingle_sets(*next(text_chunks(text_a.slice(r, 1)))[2:], size)[0])
                    x, y = held[2], sets[r - i]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked[r] = 100 * common >= percent * (len(x) + len(y) - common) and common > 0
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(linked)], names=["a", "b", "linked"])

    checked = both.mapInArrow(run, "a long, b long, linked boolean")
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def candidate_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of (at least) the given nodes, found by a scan with a sketch instead of a shuffle of
    all texts; what the sketch lets through besides joins with nothing."""
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_sketch(nodes.select(F.xxhash64("node").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_sketch(sketch.value, batch.column("h").to_numpy().view(np.uint64))
            yield batch.select(["node", "text"]).filter(pa.array(hit))

    return save(docs.select(F.xxhash64("node").alias("h"), "node", "text").mapInArrow(run, "node long, text string"), "candidates")


def rare_prefix_pairs(texts: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that can still be similar, by prefix filtering.

    Two sets of similarity t share one of the n - ceil(t n) + 1 rarest shingles of either, for any
    order of the shingles. Rarity is counted over these nodes, so most prefixes hold shingles that
    occur once and pair with nothing. The sizes fix how many shingles a pair must share, so
    the first shared one must stand early enough in both orders, and enough shingles must
    occur twice at all: both are asked in the join. No similar pair among the nodes is missed.
    A repeated row counts once; several texts of one node are sets of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, size)
                n = np.array([len(s) for s in sets])
                at = np.repeat(np.arange(j - i), n)
                own = [batch.column(c).slice(i, j - i).take(pa.array(at)) for c in ("node", "component", "row")]
                yield pa.record_batch([*own, pa.array(n[at]), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "component", "row", "n", "shingle"])

    rows = texts.join(nodes, "node").select("node", "component", "text").distinct().withColumn("row", F.monotonically_increasing_id())
    held = save(rows.mapInArrow(run, "node long, component long, row long, n long, shingle long"), "shingles")
    often = save(held.groupBy("shingle").agg(F.count("*").alias("df")), "shingle-counts")
    ranked = held.join(often, "shingle").groupBy("node", "component", "row", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"), F.count_if(F.col("df") > 1).alias("m"))  # bounded by the text's length
    ranked = ranked.filter(F.col("m") * 100 >= F.col("n") * percent)
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ranked.select("node", "component", "n", "m", F.posexplode(F.slice("s", F.lit(1), F.greatest(length, F.lit(1)).cast("int"))).alias("at", "x")).filter("x.df > 1")
    # sets that can be similar are of one size class or of neighbouring ones; a frequent shingle is dealt out as well
    size_class = F.floor(F.log("n") / math.log(100 / percent))
    prefix = save(prefix.select("node", "component", "n", "m", "at", F.col("x.shingle").alias("shingle"), size_class.alias("size"), F.ceil(F.col("x.df") / SPOKES).cast("int").alias("k")), "prefixes")
    left = prefix.select("*", F.pmod(F.xxhash64("node"), F.col("k")).alias("deal")).drop("k").toDF("a", "ca", "na", "ma", "ta", "shingle", "size", "deal")
    right = prefix.withColumn("size", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1))).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).drop("k").toDF("b", "cb", "nb", "mb", "tb", "shingle", "size", "deal")
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))  # of the intersection
    similar = (F.least("ma", "mb") >= need) & (F.col("ta") <= F.col("na") - need) & (F.col("tb") <= F.col("nb") - need)
    same_key = (left["shingle"] == right["shingle"]) & (left["size"] == right["size"]) & (left["deal"] == right["deal"])
    joined = left.join(right, same_key & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & similar)
    return joined.select("a", "b").distinct()


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "linked")).distinct()


def near_duplicates(documents: DataFrame, similarity: float = 0.8, size: int = 5, rows: int = 6, nodes_only: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over
    links, itself included) and kept (it is the one of its component that stays).

    Documents link where the Jaccard similarity of their sets of `size`-word shingles is at
    least `similarity` (to the percent). Words are lower-cased over A-Z; a text of fewer words
    is one shingle; null and empty texts have no shingles and link with nothing. Equal sets
    collapse to one representative first. In each bucket a star joins the node that shares most
    buckets to the others; those it fails form a second star. Buckets that still span several components are
    closed exactly: prefix filtering finds every pair of their documents that may link across
    components, so no linked pair that shares a bucket is lost. A null doc_id counts as larger
    than all ids and comes back null. Rows that share a doc_id are one node, linked where
    either text links. Repeated rows are each returned; extra columns are ignored.
    """
    percent = round(similarity * 100)
    docs = keyed(documents)
    signed = save(signatures(docs, size, rows, bands_for(similarity, rows)), "signatures")
    nodes = signed.filter("n_shingles > 0")
    # written, so that the joins below are plain ones that Spark can split where very many sets are equal
    sets = save(nodes.groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "sets")
    rep = F.coalesce("rep", "node")
    named = save(nodes.select("node", "d1", "d2").join(sets, ["d1", "d2"], "left").select("node", rep.alias("rep")).distinct(), "classes")
    reps = nodes.join(sets, ["d1", "d2"], "left").filter(rep == F.col("node")).select("node", F.explode("buckets").alias("bucket")).distinct()
    shared = reps.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    placed = reps.join(shared, "bucket")
    weights = placed.groupBy("node").agg(F.sum("n").alias("weight"))  # documents near the middle of a large group share most
    members = save(placed.join(weights, "node").select("bucket", "node", "weight"), "members")
    texts = candidate_texts(docs, members.select("node").distinct())

    done: DataFrame | None = None
    rest = members
    for _ in range(STARS):
        centre = F.max(F.struct("weight", (-F.col("node")).alias("a")))
        stars = save(rest.groupBy("bucket").agg(centre.alias("c"), F.count("*").alias("n")).filter("n > 1").select("bucket", (-F.col("c.a")).alias("a")), "stars")
        spokes = rest.join(stars, "bucket").filter("node <> a").select("bucket", "a", F.col("node").alias("b"), "weight")
        pairs = spokes.select("a", "b").distinct()
        if done is not None:
            pairs = pairs.join(_either_way(done).select("a", "b"), ["a", "b"], "left_anti")
        checked = save(confirm(texts, pairs, size, percent), "links")
        done = checked if done is None else done.unionByName(checked)
        rest = save(spokes.join(_either_way(done).filter("NOT linked").select("a", "b"), ["a", "b"]).select("bucket", F.col("b").alias("node"), "weight"), "rest")

    found = components(done.filter("linked").select("a", "b"))
    placed = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    spread = save(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket"), "spread")
    unsure = save(placed.join(spread, "bucket").select("node", "component").distinct(), "unsure")
    pairs = rare_prefix_pairs(texts, unsure, size, percent).join(_either_way(done).select("a", "b"), ["a", "b"], "left_anti")
    done = done.unionByName(save(confirm(texts, save(pairs, "pairs"), size, percent), "links"))
    several = named.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last").select("node", "a")
    same_id = named.join(several, "node").filter("rep <> a").select("a", F.col("rep").alias("b"))  # an id with several texts
    found = components(done.filter("linked").select("a", "b").unionByName(same_id))
    home = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("node").agg(F.min(F.coalesce("component", "rep")).alias("home"))
    out = signed.join(home, "node", "left").withColumn("home", F.coalesce("home", "node"))
    if nodes_only:
        return out.select("node", "home", (F.col("node") == F.col("home")).alias("kept"))
    real = lambda c: F.when(F.col(c) <= NO_ID - _NO_IDS, F.col(c))
    return out.select(real("node").alias("doc_id"), "n_shingles", real("home").alias("component_id"), (F.col("node") == F.col("home")).alias("kept"))


def keep_first(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of `documents` that stay: of each group of near-duplicates one row, of smallest
    doc_id; of repeated rows of that id the first by text. Texts without words all stay."""
    names = documents.columns
    found = near_duplicates(documents, similarity, nodes_only=True)
    tagged = documents.withColumn("__node", node_key())
    kept = tagged.join(found.filter("kept").select(F.col("node").alias("__node")).distinct(), "__node", "left_semi")
    once = save(kept.groupBy("__node").agg(F.count("*").alias("__n"), F.min(F.xxhash64("text")).alias("__h")).filter("__n > 1"), "repeats")
    if not once.limit(1).count():
        return kept.select(*names)
    firsts = kept.join(once, "__node").filter(F.xxhash64("text") == F.col("__h")).dropDuplicates(["__node"])
    return kept.join(once, "__node", "left_anti").select(*names).unionByName(firsts.select(*names))
