"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Every word's one-edit neighbourhood is generated as hashes alone: a rolling hash over code points
gives those of all deletions and replacements from prefix sums. They are probed against broadcast
Bloom filters, one shard for each word length, blocked so that a probe touches one 64-byte block;
only positives are shuffled to an exact join with the vocabulary, where the edit distance removes
false ones. Insertions need no probe: they are the deletions of the longer word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import code_points, save, small_batches

#: Letters that words are made of (A-Z are lower-cased first).
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)
#: Bits of a filter for each word, and words that one broadcast filter holds (12 MB); larger vocabularies are
#: filtered in rounds, so neither its size nor its error grows with the vocabulary.
WORD_BITS = 16
ROUND_WORDS = 6_000_000
#: Words of so many code points or more share one shard.
LONGEST = 4096
#: Bits set in a block for each word.
PROBES = 6
#: Hashes generated at a time.
CHUNK = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_ONE = np.uint64(1)


def vocabulary(documents: DataFrame, least: int = 7, at_least: int = 2) -> DataFrame:
    """word, n: words of at least `least` code points with `at_least` occurrences or more.

    A word is a maximal run of letters with A-Z lower-cased, and where 31 divides the crc32 of
    `doc_id:run`, that run without code point crc32 % length. Runs shorter than `least` give none; equal
    words of a task are one row before the shuffle. A null id counts as ''.
    """
    found = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"([A-Za-z\u00C0-\u00FF]{{{least},}})"), F.lit(1))).alias("run"))
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = found.select(run.alias("run"), F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run), "UTF-8")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(31)) == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def powers(size: int) -> np.ndarray:
    out = np.full(size, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a rolling hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of its words, their code points, a row each)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield size, at, letters.reshape(len(at), size).astype(np.uint64)


def hashed(words: DataFrame) -> DataFrame:
    """word, n and `h`, the word's hash (signed) that edits of other words are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(len(batch), np.uint64)
            for size, at, letters in by_length(batch.column("word").to_pylist()):
                h[at] = mixed((letters * powers(size)).sum(axis=1, dtype=np.uint64))
            yield pa.record_batch([*batch.columns, pa.array(h.view(np.int64))], names=["word", "n", "h"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, h long")


class Shards:
    """Blocks of 512 bits, dealt to word lengths in proportion to their words (one at least)."""

    def __init__(self, counts: dict[int, int], rounds: int = 1):
        self.words = counts
        self.blocks = {k: max(1, math.ceil(n * WORD_BITS / rounds / 512)) for k, n in counts.items()}
        self.first = dict(zip(self.blocks, np.cumsum([0, *self.blocks.values()]).tolist()))
        self.lanes = 8 * sum(self.blocks.values())

    def block(self, shard: int, h: np.ndarray) -> np.ndarray:
        """First 64-bit lane of each hash's block."""
        return (self.first[shard] + ((h >> np.uint64(40)) * np.uint64(self.blocks[shard]) >> np.uint64(24)).astype(np.int64)) * 8

    @staticmethod
    def probe(h: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(lane inside the block, bit of the lane) of a hash's i-th probe."""
        bit = (h + np.uint64(i) * ((h >> np.uint64(9)) | _ONE)) & np.uint64(511)
        return (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)

    def build(self, words: DataFrame) -> np.ndarray:
        """The filter of (size, h), OR-ed by Spark lane by lane. What reaches the driver is bounded by the number of lanes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, hs = batch.column("shard").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
                for s in np.unique(shard).tolist():
                    h = hs[shard == s]
                    block = self.block(s, h)
                    for lane, bit in (self.probe(h, i) for i in range(PROBES)):
                        yield pa.record_batch([pa.array(block + lane), pa.array((_ONE << bit).view(np.int64))], names=["lane", "bits"])

        with small_batches(words.sparkSession):
            made = words.mapInArrow(run, "lane long, bits long").groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
        out = np.zeros(self.lanes, np.uint64)
        out[made["lane"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
        return out

    def positive(self, bloom: np.ndarray, shard: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be words of this shard; each probe looks only at what the last one left."""
        block, at = self.block(shard, h), np.arange(len(h))
        for i in range(PROBES):
            lane, bit = self.probe(h[at], i)
            at = at[(bloom[block[at] + lane] >> bit) & _ONE == 1]
        return at


def edits(letters: np.ndarray, shards: Shards) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, places of words, places in them, new letters (0: deleted), hashes) of edits: one of each pair of words that are a replacement apart reaches
    the other by a later letter, and equal neighbours are deleted once. Lengths without other words are left out."""
    count, size = letters.shape
    power = powers(size)
    weighted = letters * power
    upto = np.cumsum(weighted, axis=1, dtype=np.uint64)
    whole = upto[:, -1]
    shorter, same = min(size - 1, LONGEST), min(size, LONGEST)
    if shorter in shards.words:
        first = np.ones(letters.shape, bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        row, at = np.nonzero(first)
        for i in range(0, len(row), CHUNK):
            r, p = row[i : i + CHUNK], at[i : i + CHUNK]
            yield shorter, r, p, np.zeros(len(r), np.uint64), mixed(upto[r, p] - weighted[r, p] + (whole[r] - upto[r, p]) * _INVERSE)
    if shards.words.get(same, 0) > 1:
        step = max(1, CHUNK // len(LETTERS))
        for i in range(0, count * size, step):
            r, p = np.divmod(np.arange(i, min(i + step, count * size)), size)
            old = letters[r, p]
            later = LETTERS[None, :] > old[:, None]
            new = (LETTERS[None, :] - old[:, None]) * power[p][:, None] + whole[r][:, None]
            pair, letter = np.nonzero(later)
            yield same, r[pair], p[pair], LETTERS[letter], mixed(new[later])


def candidates(words: DataFrame, shards: Shards, bloom, turn: int, rounds: int) -> DataFrame:
    """h (a word's), place and letter of an edit, and edit (its hash, which the filter of this round lets through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("h").to_numpy()
            for _, at, letters in by_length(batch.column("word").to_pylist()):
                for shard, *columns, h in edits(letters, shards):
                    mine = np.flatnonzero(h % np.uint64(rounds) == turn)
                    hit = mine[shards.positive(bloom.value, shard, h[mine])]
                    if len(hit):
                        row, place, letter = (c[hit] for c in columns)
                        made = [own[at[row]], place.astype(np.int32), letter.astype(np.int32), h[hit].view(np.int64)]
                        yield pa.record_batch([pa.array(c) for c in made], names=["h", "place", "letter", "edit"])

    return words.select("word", "h").mapInArrow(run, "h long, place int, letter int, edit long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words of (word, n, h) that are one insertion, deletion or replacement apart, once.

    A word has at most as many partners as one-edit forms, so no join key is hot. The edit is made again on
    the word itself and must give the other one, so neither the filter nor the hash decides.
    """
    spark = words.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONGEST)).alias("shard")
    counts = {r.shard: r.n for r in words.groupBy(shard).agg(F.count("*").alias("n")).orderBy("shard").collect()}
    rounds = max(1, math.ceil(sum(counts.values()) / ROUND_WORDS))
    shards = Shards(counts, rounds)
    found = []
    for turn in range(rounds):
        # h is signed here and unsigned in a task: 2^64 % rounds puts both on the same residue.
        residue = F.pmod(F.pmod("h", F.lit(rounds)) + F.when(F.col("h") < 0, F.lit((1 << 64) % rounds)).otherwise(F.lit(0)), F.lit(rounds))
        bloom = spark.sparkContext.broadcast(shards.build(words.filter(residue == turn).select(shard, "h")))
        found.append(save(candidates(words, shards, bloom, turn, rounds), "edits"))
        bloom.destroy()
    positive = reduce(DataFrame.unionByName, found)
    a = words.select("h", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = words.select(F.col("h").alias("edit"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    letter = F.when(F.col("letter") == 0, "").otherwise(F.char("letter"))
    made = F.concat(F.col("a").substr(F.lit(1), F.col("place")), letter, F.col("a").substr(F.col("place") + 2, F.char_length("a")))
    return positive.join(b, "edit").join(a, "h").filter(made == F.col("b")).select("a", "n_a", "b", "n_b")


def followed(forms: DataFrame, most: int, times: int) -> DataFrame:
    """word, root of (word, form): each form has at least `times` occurrences for each of the word's, and no word has more
    than `most`, so chains are short; every round doubles the length that is followed."""
    depth = 0
    while 2 * times ** (depth + 1) <= most:
        depth += 1
    out = save(forms.select("word", F.col("form").alias("root")), "roots")
    for i in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        out = save(out.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), f"roots{i}")
    return out


def spelling_variants(documents: DataFrame, least: int = 7, at_least: int = 2, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of `vocabulary`.

    n_near counts the words one edit away. The form is the one of them with the most occurrences (of
    ties the first by code points), if it has at least `times` as many as the word; root follows forms
    to the last. Null and empty texts give no words, repeated rows count each, other columns are
    ignored, an empty table gives no rows. The rows of one word need not fit a task: words are counted
    before they are shuffled, and a word has few neighbours.
    """
    spark = documents.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Dealt out by hand: a small table of words still has many edits to probe.
    words = save(hashed(save(vocabulary(documents, least, at_least), "words").repartition(parts, "word")), "vocabulary")
    pairs = near_pairs(words)
    sides = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{x}").alias("n"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba"))))
    each = pairs.select(sides.alias("x")).select("x.*")
    best = each.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), code_points(F.col("near")).alias("order"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.less") >= F.lit(times) * F.col("n")
    near = save(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    most = words.agg(F.max("n").alias("most")).first().most or 0
    roots = followed(near.filter(F.col("form").isNotNull()), most, times)
    out = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


#: The 16 steps of crc32 by half bytes (fixed values).
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"

SQL = rf"""WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(generate_series(0, length(x) - 1), lambda i: (instr('0123456789ABCDEF', x[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1)::UBIGINT)),
    lambda c, d: xor(c >> 4, {_CRC}[1 + (xor(c, d) & 15)::BIGINT]::UBIGINT))) AS h FROM counted),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
pairs AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM cuts a JOIN cuts b ON a.i = b.i AND a.c = b.c AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT x.word, x.n, w.word, w.n FROM cuts x JOIN words w ON w.word = x.c
    UNION SELECT w.word, w.n, x.word, x.n FROM cuts x JOIN words w ON w.word = x.c),
best AS (SELECT a AS word, count(*) AS n_near, min((-nb, encode(b), b)) AS m, any_value(na) AS n FROM pairs GROUP BY a),
forms AS MATERIALIZED (SELECT word, n_near, CASE WHEN -m[1] >= 10 * n THEN m[3] END AS form, CASE WHEN -m[1] >= 10 * n THEN -m[1] END AS form_n FROM best),
chains AS (SELECT word, word AS root FROM words UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chains c LEFT JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, form_n, root FROM words w JOIN roots USING (word) LEFT JOIN forms USING (word)"""
