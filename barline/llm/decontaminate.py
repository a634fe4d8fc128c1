"""Benchmark decontamination: rare n-gram seeds join training passages to test items, then
Smith-Waterman alignment scores verbatim, edited and paraphrased copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import Words, as_long, text_chunks, token_rows, window_hash
from .shared import in_sketch, keyed, part_of_text, repeated_sketch, save

MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of more words are paired by their seeds alone.
LONG_ITEM = 256
#: Pairs of seed and word that a task looks up at a time.
PAIRS_AT_ONCE = 1_000_000


def _seeds(data: np.ndarray, offsets: np.ndarray, n: int):
    """Word hashes, row offsets, and the n-gram hashes with their first words."""
    words = Words(data, offsets, lower=True, lanes=1, latin=True)
    lane, rows = words.lanes[0], words.row_offsets
    grams = window_hash(lane, n)
    row = token_rows(rows)[: len(grams)]
    at = np.flatnonzero(np.arange(n, len(grams) + n) <= rows[row + 1]) if len(grams) else np.zeros(0, np.int64)
    return lane, rows, grams, at


def item_words(items: DataFrame, n: int) -> DataFrame:
    """item_id, the hashes of its words, and its distinct n-grams (all words where fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                lane, rows, grams, at = _seeds(data, offsets, n)
                starts = np.searchsorted(at, rows)
                words = [lane[rows[r] : rows[r + 1]].view(np.int64) for r in range(j - i)]
                seeds = [np.unique(grams[at[starts[r] : starts[r + 1]]]).view(np.int64) for r in range(j - i)]
                yield pa.record_batch([batch.column("item_id").slice(i, j - i), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["item_id", "item", "seeds"])

    return items.selectExpr("cast(item_id AS bigint) AS item_id", "text").mapInArrow(run, "item_id long, item array<long>, seeds array<long>")


def seed_hits(docs: DataFrame, sketch, n: int) -> DataFrame:
    """Every occurrence of a seed in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                _, _, grams, at = _seeds(data, offsets, n)
                h = grams[at]
                yield pa.record_batch([as_long(h[in_sketch(sketch.value, h)])], names=["seed"])

    return docs.select("text").mapInArrow(run, "seed long")


def pair_keys(seed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash for a seed and a word; word 0 stands for any."""
    x = seed * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def needed_words(known: DataFrame, least: float) -> DataFrame:
    """item_id, item_key, word: words of each item of which any copy that can score `least` holds one.

    A copy holds at least `least` of the item's words, so it holds one of any words that leave fewer
    than that. The words that stand in the fewest items come first, those that many items share last.
    """
    own = ["item_id", "item_key"]
    each = known.select(*own, F.size("item").alias("size"), F.explode("item").alias("word")).groupBy(*own, "size", "word").agg(F.count("*").alias("times"))
    spread = each.groupBy("word").agg(F.count("*").alias("items"))
    before = F.sum("times").over(Window.partitionBy(*own).orderBy("items", "word").rowsBetween(Window.unboundedPreceding, -1))
    ranked = each.join(spread, "word").withColumn("before", F.coalesce(before, F.lit(0)))
    return ranked.filter(F.col("size") - F.col("before") >= F.ceil(F.lit(least) * F.col("size"))).select(*own, "word")


def item_keys(rare: DataFrame, needed: DataFrame, known: DataFrame) -> DataFrame:
    """item_id, item_key, key: each rare seed of an item beside each of its needed words, or alone where the item
    has more than LONG_ITEM words (their number would grow with its square)."""
    own = ["item_id", "item_key"]
    short = known.filter(F.size("item") <= LONG_ITEM).select(*own)
    seeds = rare.groupBy(*own).agg(F.collect_set("seed").alias("seeds"))
    words = needed.join(short, own, "left_semi").groupBy(*own).agg(F.collect_set("word").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = batch.column("words")[i].values
                word = np.zeros(1, np.uint64) if words is None else words.to_numpy().view(np.uint64)
                keys = np.unique(pair_keys(batch.column("seeds")[i].values.to_numpy().view(np.uint64)[:, None], word[None, :]))
                ids = [batch.column(c).take(pa.array(np.full(len(keys), i))) for c in own]
                yield pa.record_batch([*ids, pa.array(keys.view(np.int64))], names=[*own, "key"])

    return seeds.join(words, own, "left").mapInArrow(run, "item_id long, item_key long, key long")


def passages(docs: DataFrame, rare, wanted, n: int, reach: int) -> DataFrame:
    """Stretches of documents around rare seeds that stand near a needed word of the seed's item: seeds
    at most `reach` words apart form one, with `reach` words of context on either side, and `keys` tells
    which pairs of seed and word it holds. What can be aligned with a seed lies within twice `reach` of it."""
    far = 2 * min(reach, LONG_ITEM)  # longer items have no needed words
    near = np.arange(-far, n + far)

    def keys_at(lane: np.ndarray, rows: np.ndarray, gram: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `at`, keys) of the wanted pairs, a bounded number of seeds at a time."""
        places, keys, step = [], [], max(1, PAIRS_AT_ONCE // len(near))
        for a in range(0, len(at), step):
            p = at[a : a + step, None] + near[None, :]
            word = np.where((p >= rows[row[a : a + step]][:, None]) & (p < rows[row[a : a + step] + 1][:, None]), lane[np.clip(p, 0, len(lane) - 1)], np.uint64(0))
            both = pair_keys(gram[a : a + step, None], np.concatenate([np.zeros((len(word), 1), np.uint64), word], axis=1))
            where = np.flatnonzero(in_sketch(wanted.value, both.ravel()))
            places.append(a + where // both.shape[1])
            keys.append(both.ravel()[where])
        return np.concatenate(places), np.concatenate(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, parts = batch.column("doc_key").to_numpy(), batch.column("part").to_numpy()
            for i, _, data, offsets in text_chunks(batch.column("text")):
                lane, rows, grams, at = _seeds(data, offsets, n)
                at = at[in_sketch(rare.value, grams[at])]
                if not len(at):
                    continue
                row = token_rows(rows)[at]
                place, key = keys_at(lane, rows, grams[at], at, row)
                if not len(place):
                    continue
                held = np.unique(place)
                place = np.searchsorted(held, place)
                at, row = at[held], row[held]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] - at[:-1] > reach)))
                end = np.append(new[1:], len(at))
                own = row[new]
                lo, hi = np.maximum(at[new] - reach, rows[own]), np.minimum(at[end - 1] + n + reach, rows[own + 1])
                first, last = np.searchsorted(place, new), np.searchsorted(place, end)
                keys = [np.unique(key[a:b]).view(np.int64) for a, b in zip(first, last)]
                words = [lane[a:b].view(np.int64) for a, b in zip(lo, hi)]
                yield pa.record_batch(
                    [pa.array(doc[i + own]), pa.array(parts[i + own]), pa.array((lo - rows[own]).astype(np.int64)), pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_key", "part", "begin", "words", "keys"],
                )

    return docs.select("doc_key", "part", "text").mapInArrow(run, "doc_key long, part long, begin long, words array<long>, keys array<long>")


def smith_waterman(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of an item in a passage: score as a share of the item aligned with
    itself, and the passage words it spans. One row of the matrix per item word; the gaps
    along a row are a running maximum."""
    n = len(passage)
    slope = np.arange(n + 1) * -GAP
    prev, prev_from = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        step = np.zeros(n + 1, dtype=np.int64)
        step[1:] = prev[:-1] + np.where(passage == word, MATCH, MISMATCH)
        step_from = np.append(0, prev_from[:-1])
        up = prev + GAP
        step_from = np.where(up > step, prev_from, step_from)
        step = np.maximum(step, up)
        fresh = step <= 0
        step[fresh], step_from[fresh] = 0, np.arange(n + 1)[fresh]
        lifted = step + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        now = np.maximum(top - slope, 0)
        now_from = np.where(now > 0, step_from[source], np.arange(n + 1))
        at = int(now.argmax())
        if now[at] > best:
            best, span = int(now[at]), (int(now_from[at]), at)
        prev, prev_from = now, now_from
    return best / (MATCH * len(item)), span[0], span[1]


def contaminated(documents: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, factor: float = 8.0) -> DataFrame:
    """doc_id, item_id, score, begin and end (words) for each document that holds a test item.

    Seeds are the items' n-grams of lower-cased (A-Z, À-Þ) words. A seed is rare if it occurs in the
    corpus at most `factor` times as often as the upper quartile of its item's occurring seeds, so
    an item leaked whole or in half into a third of the corpus keeps its seeds. Passages that share
    a rare seed with an item, near it one of the words that its copies cannot all lack, and `least` of
    its words are aligned with it, so a phrase that many items share pairs nothing by itself. They count from
    score `least`: twice the matches less the edits, over twice the item's words. A copy without
    n words in a row from its item, items of fewer than n words and null or empty texts match nothing. An item is reported once per document, by its best
    alignment. Null ids come back null; rows that share an id but not a text are told apart;
    repeated rows are reported once. Extra columns are ignored.
    """
    spark = documents.sparkSession
    docs = keyed(documents)
    known = save(item_words(items, n).withColumn("item_key", F.xxhash64("item")).distinct(), "items")
    own = ["item_id", "item_key"]
    seeds = known.select(*own, F.explode("seeds").alias("seed"))
    all_seeds = spark.sparkContext.broadcast(repeated_sketch(seeds.select("seed").distinct(), "seed"))
    counts = seed_hits(docs, all_seeds, n).groupBy("seed").agg(F.count("*").alias("times"))
    usual = seeds.join(save(counts, "seed-counts"), "seed")
    quartile = usual.groupBy(*own).agg(F.percentile_approx("times", 0.75).alias("quartile"))
    rare = usual.join(quartile, own).filter(F.col("times") <= factor * F.col("quartile")).select(*own, "seed")
    rare = save(rare, "rare-seeds")
    keys = save(item_keys(rare, needed_words(known, least), known), "item-keys")
    reach = known.agg(F.max(F.size("item"))).first()[0] or 0
    some, wanted = (spark.sparkContext.broadcast(repeated_sketch(x.distinct(), x.columns[0])) for x in (rare.select("seed"), keys.select("key")))
    found = save(passages(docs, some, wanted, n, reach), "passages")
    place = ["doc_key", "part", "begin"]
    met = found.select(*place, F.explode("keys").alias("key")).join(keys, "key").select(*place, *own).distinct()
    pairs = met.join(known.select(*own, "item"), own).join(found.drop("keys").distinct(), place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, item in zip(batch.column("words"), batch.column("item")):
                words, item = words.values.to_numpy(), item.values.to_numpy()
                enough = np.isin(item, words).sum() >= least * len(item)  # each match is a word of the item
                out.append(smith_waterman(words, item) if enough else (0.0, 0, 0))
            score, lo, hi = (np.array(x) for x in zip(*out)) if out else (np.zeros(0),) * 3
            begin = batch.column("begin").to_numpy()
            yield pa.record_batch([batch.column("doc_key"), batch.column("part"), batch.column("item_id"), pa.array(score.astype(float)), pa.array((begin + lo).astype(np.int64)), pa.array((begin + hi).astype(np.int64))], names=["doc_key", "part", "item_id", "score", "begin", "end"])

    scored = pairs.select(*place, "item_id", "words", "item").mapInArrow(run, "doc_key long, part long, item_id long, score double, begin long, end long").filter(F.col("score") >= least)
    best = scored.groupBy("doc_key", "part", "item_id").agg(F.max(F.struct("score", (-F.col("begin")).alias("at"), "end")).alias("b"))
    return best.select("doc_key", "part", F.when(F.col("doc_key") < F.lit((1 << 63) - 1), F.col("doc_key")).alias("doc_id"), "item_id", F.round("b.score", 6).alias("score"), (-F.col("b.at")).alias("begin"), F.col("b.end").alias("end"))


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `documents` that hold no test item, with their columns."""
    hit = save(contaminated(documents, items).select("doc_key", "part").distinct(), "contaminated")
    names = documents.columns
    tagged = documents.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__part": part_of_text()})
    return tagged.join(hit.toDF("__key", "__part"), ["__key", "__part"], "left_anti").select(*names)
