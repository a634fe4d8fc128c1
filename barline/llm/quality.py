"""Line-first quality rules: judge every line, remove failures, then reject documents that lose too much.

Boilerplate is learned from the corpus (lines that many documents of a source hold in different
surroundings) beside a short list of phrases. All rules run on Arrow batches: words, lines and
windows are arrays of offsets and hashes (two 64-bit lanes), not Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import IS_SPACE, Words, as_long, byte_lanes, mix, span_hash, text_chunks, window_hash
from .shared import save

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Words that separate the items of a navigation line.
SEPARATORS = ("|", "»", "›", ">", "/", "•", "·", "::", "-", "–", "—")
#: Phrases of boilerplate that are known without a corpus.
PHRASES = (
    "all rights reserved", "cookie (policy|settings)", "accept (all )?cookies", "privacy policy", "terms (of use|of service|and conditions)", "click here", "read more", "sign (in|up)", "log ?in",
    "subscribe (now|to our)", "add to cart", "share (this|on)", "follow us", "skip to (main )?content", "lorem ipsum", "enable javascript", "back to top",
)
_CLOSED = r"""[.!?:;…。！？]['"”’»)\]]*[\x20\x09-\x0D]*$"""
FAULTS = ("repeated", "navigation", "symbols", "stutter", "boilerplate", "punctuation", "letters")
_NAMES = [",".join(sorted(f for i, f in enumerate(FAULTS) if bits >> i & 1)) for bits in range(1 << len(FAULTS))]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the document verdict."""

    symbol_share: float = 0.3  # words of a line that end in symbols
    separator_share: float = 0.25  # navigation: words of a line that are separators
    short_line: int = 12  # boilerplate phrases count in lines of at most so many words
    stutter_share: float = 0.3  # words of a line that equal the word before
    open_words: int = 4  # a line without closing punctuation needs more words than this
    least_words: int = 20
    repeat_percent: int = 30
    most_lost: float = 0.5  # share of a document's words in failed lines
    common_line: int = 20  # learned boilerplate: at most so many words,
    common_documents: int = 20  # in at least so many documents,
    common_share: float = 0.01  # this share of its source's documents
    common_of_all: float = 0.0001  # and this share of all documents (so few lines are learned: see common_lines),
    common_surroundings: int = 10  # between at least so many different pairs of lines


RULES = Rules()
_NOTHING = np.zeros(0, dtype=np.uint64)


class Lines:
    """The \\n-split lines of a chunk of texts: byte spans, row, words, hashes, and which repeat an
    earlier line of their text (lines without a word never do)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: Words):
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]))
        self.row = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(breaks, offsets)))
        self.first, self.last = np.searchsorted(words.starts, self.starts), np.searchsorted(words.starts, self.ends)
        self.n = self.last - self.first
        self.hash, second = (span_hash(lane, self.starts, self.ends) for lane in byte_lanes(data))
        order = np.lexsort((second, self.hash, self.row))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (self.row[order[1:]] == self.row[order[:-1]]) & (self.hash[order[1:]] == self.hash[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        self.repeated = np.zeros(len(order), dtype=bool)
        self.repeated[order] = same
        self.repeated &= self.n > 0


def _between(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many flags are set in each [first, last)."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[np.maximum(last, first)] - total[first]


def repeated_words(words: Words, n: int = 8) -> np.ndarray:
    """Words of each row inside n-word windows that occur at least twice in the row."""
    first, second = (window_hash(lane, n) for lane in words.lanes)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.flatnonzero(np.arange(n, len(first) + n) <= words.row_offsets[1:][row[: len(first)]]) if len(first) else np.zeros(0, np.int64)
    first, second, own = first[at], second[at], row[at]
    order = np.lexsort((second, mix(first + own.astype(np.uint64))))
    a, b = order[1:], order[:-1]
    same = (first[a] == first[b]) & (second[a] == second[b]) & (own[a] == own[b])
    often = np.zeros(len(at), dtype=bool)
    often[a[same]] = often[b[same]] = True
    edges = np.zeros(len(row) + 1, dtype=np.int64)
    np.add.at(edges, at[often], 1)
    np.add.at(edges, at[often] + n, -1)
    return _between(np.cumsum(edges[:-1]) > 0, words.row_offsets[:-1], words.row_offsets[1:])


def _separators() -> np.ndarray:
    joined = np.frombuffer(" ".join(SEPARATORS).encode(), np.uint8)
    return np.sort(Words(joined, np.array([0, len(joined)]), lanes=1).lanes[0])


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _line_keys(lines: Lines, source: np.ndarray) -> np.ndarray:
    return mix(lines.hash + mix(source[lines.row]))


def judge(data: np.ndarray, offsets: np.ndarray, source: np.ndarray | None = None, common: np.ndarray = _NOTHING, rules: Rules = RULES) -> dict[str, np.ndarray]:
    """Base measures, lost words, the rules that failed, the verdict and the clean text of each row of
    a chunk. `common` are the sorted keys of learned boilerplate lines, `source` the rows' source hashes."""
    words = Words(data, offsets)
    lines = Lines(data, offsets, words)
    rows = len(offsets) - 1
    n = words.counts
    per_row = lambda flags: _between(flags, offsets[:-1], offsets[1:])
    length = words.ends - words.starts
    last, before = data[words.ends - 1], data[np.maximum(words.ends - 2, 0)]
    marked = (length > 1) & ((_SYMBOL[last] & _SYMBOL[before]) | ((last == 33) & (before == 33)))
    again = np.zeros(len(length), dtype=bool)
    again[1:] = (words.lanes[0][1:] == words.lanes[0][:-1]) & (words.lanes[1][1:] == words.lanes[1][:-1])
    # each line with its line break, as Arrow strings over the same bytes
    text = pa.Array.from_buffers(pa.large_string(), len(lines.starts), [None, pa.py_buffer(np.append(lines.starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    found = lambda pattern, **options: np.asarray(pc.match_substring_regex(text, pattern, **options))
    boilerplate = (lines.n <= rules.short_line) & found(rf"\b(?:{'|'.join(PHRASES)})\b", ignore_case=True)
    if len(common):
        boilerplate |= (lines.n <= rules.common_line) & _in_sorted(_line_keys(lines, source), common)
    tests = [
        lines.repeated,
        _between(_in_sorted(words.lanes[0], _separators()), lines.first, lines.last) >= np.maximum(2, rules.separator_share * lines.n),
        _between(marked, lines.first, lines.last) > rules.symbol_share * lines.n,
        (lines.n >= 8) & (_between(again, np.minimum(lines.first + 1, lines.last), lines.last) > rules.stutter_share * lines.n),
        boilerplate,
        (lines.n <= rules.open_words) & ~found(_CLOSED),
        ~found(r"\p{L}"),
    ]
    fault = np.where(lines.n > 0, np.select(tests, np.arange(len(FAULTS)), -1), -1)  # the first rule that fails
    failed = fault >= 0
    lost = np.bincount(lines.row, np.where(failed, lines.n, 0), minlength=rows).astype(np.int64)
    bits = np.zeros(rows, dtype=np.int64)
    np.bitwise_or.at(bits, lines.row[failed], 1 << fault[failed])
    repeats = repeated_words(words)
    base_failed = (n < rules.least_words) | (100 * repeats > rules.repeat_percent * n)
    good = (n > 0) & (lost <= rules.most_lost * n) & (n - lost >= rules.least_words)
    clean = [None if b else data[x:y].tobytes() for b, x, y in zip(bits, offsets, offsets[1:])]
    for r in np.flatnonzero(bits):
        a, b = np.searchsorted(lines.row, [r, r + 1])
        clean[r] = b"\n".join(data[x:y].tobytes() for x, y, f in zip(lines.starts[a:b], lines.ends[a:b], failed[a:b]) if not f)
    return {
        "n_words": n, "word_chars": per_row(((data & 0xC0) != 0x80) & ~IS_SPACE[data]), "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": np.bincount(lines.row, lines.repeated, minlength=rows).astype(np.int64),
        "n_repeat_words": repeats, "base_failed": base_failed, "kept": ~base_failed & good, "n_lost_words": lost, "failed_rules": np.array([_NAMES[b] for b in bits], dtype=object), "clean_text": np.array(clean, dtype=object),
    }


_FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(),
    "kept": pa.bool_(), "n_lost_words": pa.int64(), "failed_rules": pa.string(), "clean_text": pa.string(),
}
_DDL = ", ".join(f"{k} {dict(int64='long', bool='boolean', string='string')[str(t)]}" for k, t in _FIELDS.items())


def _source(documents: DataFrame) -> Column:
    return F.xxhash64(F.col("source").cast("string")) if "source" in documents.columns else F.lit(0).cast("long")


def common_lines(documents: DataFrame, rules: Rules = RULES) -> np.ndarray:
    """Sorted keys of the lines that are boilerplate of their source (null is a source too): short, in
    enough of its documents and of all documents, and between enough different lines, so that
    groups of copied documents alone make no boilerplate. All documents are counted.

    Each key stands in `common_of_all` of all documents, so there are at most 1 / common_of_all
    times as many as a document has short lines on average, whatever the corpus' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("source").to_numpy()
            for i, j, data, offsets in text_chunks(batch.column("text")):
                lines = Lines(data, offsets, Words(data, offsets, lanes=0))
                edge = np.append(True, lines.row[1:] != lines.row[:-1]) if len(lines.row) else np.zeros(0, bool)
                behind = np.where(edge, np.uint64(1), np.append(np.uint64(1), lines.hash[:-1]))
                ahead = np.where(np.append(edge[1:], True), np.uint64(2), np.append(lines.hash[1:], np.uint64(2)))
                short = (lines.n > 0) & (lines.n <= rules.common_line) & ~lines.repeated
                own = source[i:j].view(np.uint64)
                yield pa.record_batch([as_long(own[lines.row[short]]), as_long(_line_keys(lines, own)[short]), as_long(mix(mix(behind) + ahead)[short])], names=["source", "line", "around"])

    docs = documents.select(_source(documents).alias("source"), "text")
    sizes = save(docs.groupBy("source").agg(F.count("*").alias("size")), "sources")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    places = docs.mapInArrow(run, "source long, line long, around long").groupBy("source", "line", "around").agg(F.count("*").alias("n"))
    often = places.groupBy("source", "line").agg(F.sum("n").alias("n"), F.count("*").alias("surroundings"))
    often = often.filter((F.col("n") >= max(rules.common_documents, rules.common_of_all * total)) & (F.col("surroundings") >= rules.common_surroundings))
    lines = often.join(sizes, "source").filter(F.col("n") >= rules.common_share * F.col("size")).select("line").toArrow()
    return np.sort(lines.column("line").to_numpy().view(np.uint64))


def quality_rules(documents: DataFrame, rules: Rules = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, n_lost_words, failed_rules and clean_text
    (the text without its failed lines) for every document.

    A document fails the base rules with fewer than `least_words` words or with over
    `repeat_percent` % of them in 8-word windows that occur twice. Otherwise each line is judged
    (repeated lines, navigation, symbols, stutter, boilerplate, closing punctuation, letters) and
    the document is rejected if failed lines hold more than `most_lost` of its words or fewer
    than `least_words` words are left. Null and empty texts have no words and fail. One pass to
    learn boilerplate, one to judge; texts are not shuffled. Repeated rows are each judged; null
    ids come back null; a table without `source` is one source; other columns are ignored.
    """
    common = documents.sparkSession.sparkContext.broadcast(common_lines(documents, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source = batch.column("doc_id"), batch.column("source").to_numpy().view(np.uint64)
            for i, j, data, offsets in text_chunks(batch.column("text")):
                found = judge(data, offsets, source[i:j], common.value, rules)
                columns = [_column(found[k], t) for k, t in _FIELDS.items()]
                yield pa.record_batch([ids.slice(i, j - i), *columns], names=["doc_id", *_FIELDS])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _source(documents).alias("source"), "text")
    return docs.mapInArrow(run, f"doc_id long, {_DDL}")


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.binary()).cast(kind) if values.dtype == object and len(values) and isinstance(values[0], bytes) else pa.array(values, kind)


def filter_documents(documents: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The rows of `documents` that pass, with their columns; `text` is the clean text (without the
    lines that failed). Nulls, ties, repeats, empty tables and clashes as in quality_rules."""
    common = documents.sparkSession.sparkContext.broadcast(common_lines(documents, rules))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(len(names)).to_numpy().view(np.uint64)
            at = names.index("text")
            for i, j, data, offsets in text_chunks(batch.column(at)):
                found = judge(data, offsets, source[i:j], common.value, rules)
                keep = pa.array(found["kept"])
                columns = [batch.column(c).slice(i, j - i) for c in range(len(names))]
                columns[at] = _column(found["clean_text"], pa.string()).cast(batch.schema.field(at).type)
                yield pa.record_batch([c.filter(keep) for c in columns], schema=pa.schema([batch.schema.field(c) for c in range(len(names))]))

    return documents.select(*names, _source(documents).alias("__source")).mapInArrow(run, documents.schema)
