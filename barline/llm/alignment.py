"""Cross-tokenizer alignment: where two tokenizers' tokens end together, by galloping intersection.

A is a byte-level BPE (a `tokenizers` file), B a piece model with byte fallback (a `sentencepiece`
file). Both lists of token ends are byte offsets into space+text. The shorter list drives: from the
last place in the longer one an exponential search brackets a block of its ends, a binary search
places each of them. Common ends slice the tokens into groups, and differences of ranks give for
each token the range of the other side's tokens that it overlaps.

A space after a character that is no white space always starts a token on both sides: A's pattern
splits there, and no piece of B goes on with a space (checked when it is loaded). Words of a batch are
therefore encoded once each, and a text of any length is encoded whole, word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

TOKENIZERS = "/opt/tokenizers"
#: Texts are taken in groups of about so many characters, and encoded words are forgotten beyond so many tokens.
GROUP_CHARS = 2_000_000
CACHE_TOKENS = 3_000_000
#: Ends of the shorter list that are searched at a time.
BLOCK = 256
#: New words that are encoded together.
LINE_WORDS = 200

#: A space and what follows, up to the next space that stands after a character that is no white space.
_WORD = re.compile(r" \s*+(?:\S++[^\S ]\s*+)*+\S*+")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies of a folder, with the bytes of every token."""

    def __init__(self, folder: str = TOKENIZERS):
        import sentencepiece
        import tokenizers

        self.byte = tokenizers.Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        self.byte.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        decode = byte_of_char()
        self.a_bytes = [b""] * self.byte.get_vocab_size()
        for token, i in self.byte.get_vocab().items():
            self.a_bytes[i] = bytes(decode[c] for c in token)
        self.b_bytes = []
        for i in range(self.piece.get_piece_size()):
            token = self.piece.id_to_piece(i)
            self.b_bytes.append(bytes([int(token[3:5], 16)]) if self.piece.is_byte(i) else token.replace("▁", " ").encode())
        if any(re.search(rb"[^ ] ", t) for t in self.b_bytes):
            raise ValueError("pieces go on with a space after another character: words cannot be encoded one by one")

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for words that start with a space. B adds that itself, but not to nothing."""
        a = [e.ids for e in self.byte.encode_batch_fast(words, add_special_tokens=False)]
        b = self.piece.encode([w[1:] for w in words], num_threads=1)
        return a, [ids if w != " " else [self.piece.piece_to_id("▁")] for w, ids in zip(words, b)]

    def suffix_pairs(self) -> int:
        """How many id pairs can end together at all: one token's bytes end the other's. This bounds the table of counts."""
        ids: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for side, tokens in zip(ids, (self.a_bytes, self.b_bytes)):
            for t in tokens:
                side[t] = side.get(t, 0) + 1
        n = sum(ids[1].get(t[k:], 0) for t in self.a_bytes for k in range(len(t)))
        return n + sum(ids[0].get(t[k:], 0) for t in self.b_bytes for k in range(1, len(t)))


@lru_cache(maxsize=2)
def load(folder: str) -> Tokenizers:
    return Tokenizers(folder)


class WordTable:
    """Encoded words of one task: flat ids of both sides, and where each word's lie."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.a_size = np.array([len(t) for t in tokenizers.a_bytes])
        self.b_size = np.array([len(t) for t in tokenizers.b_bytes])
        self.clear()

    def clear(self) -> None:
        self.rank: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32)] * 2
        self.size = [np.zeros(0, np.int64)] * 2
        self.start = [np.zeros(0, np.int64)] * 2
        self.odd = np.zeros(0, bool)

    def learn(self, words: set[str]) -> None:
        """Encode the words not seen yet: most of them many at a time, in lines that are cut at the words' ends."""
        if len(self.flat[0]) > CACHE_TOKENS:
            self.clear()
        new = sorted(words - self.rank.keys())
        lined = [w for w in new if not w[-1].isspace()]
        lines = [lined[i : i + LINE_WORDS] for i in range(0, len(lined), LINE_WORDS)]
        single = [w for w in new if w[-1].isspace()]
        exact: tuple[list[str], list[int], list[int]] = ([], [], [])
        for line, a, b in zip(lines, *self.tokenizers.encode(["".join(line) for line in lines])):
            if self.same_bytes("".join(line), a, b):
                for kept, more in zip(exact, (line, a, b)):
                    kept.extend(more)
            else:
                single += line
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in exact[0]), np.int64, len(exact[0])))
        self.add(exact[0], [self.cut(size, ids, ends) for size, ids in zip((self.a_size, self.b_size), exact[1:])], [False] * len(exact[0]))
        a, b = self.tokenizers.encode(single)
        sides = [(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)) for ids in (a, b)]
        self.add(single, sides, [not self.same_bytes(w, *ids) for w, *ids in zip(single, a, b)])

    def same_bytes(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = text.encode()
        return all(b"".join(map(t.__getitem__, ids)) == whole for t, ids in ((self.tokenizers.a_bytes, a), (self.tokenizers.b_bytes, b)))

    @staticmethod
    def cut(size: np.ndarray, ids: list[int], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each word has), for words that end at the given bytes."""
        flat = np.array(ids, np.int32)
        return flat, np.diff(np.searchsorted(np.cumsum(size[flat]), ends, side="right"), prepend=0)

    def add(self, words: list[str], sides: list[tuple[np.ndarray, np.ndarray]], odd: list[bool]) -> None:
        self.rank.update(zip(words, range(len(self.rank), len(self.rank) + len(words))))
        self.odd = np.concatenate([self.odd, np.array(odd, bool)])
        for k, (flat, size) in enumerate(sides):
            self.flat[k] = np.concatenate([self.flat[k], flat])
            self.size[k] = np.concatenate([self.size[k], size])
            self.start[k] = np.cumsum(self.size[k]) - self.size[k]

    def tokens(self, side: int, at: np.ndarray) -> np.ndarray:
        """Ids of a sequence of words, given by their ranks."""
        size = self.size[side][at]
        first = np.repeat(self.start[side][at] - (np.cumsum(size) - size), size)
        return self.flat[side][first + np.arange(len(first))]

    def encode(self, text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of space+text; none where either side's bytes differ from it."""
        at = np.fromiter(map(self.rank.__getitem__, words), np.int64, len(words))
        a, b = self.tokens(0, at), self.tokens(1, at)
        if self.odd[at].any() and not self.same_bytes(" " + text, a.tolist(), b.tolist()):
            return a[:0], b[:0]
        return a, b


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two strictly rising lists, the first being the shorter one.

    Each block of the shorter list starts where the last one ended in the longer; the bracket's width
    doubles until it holds the block's last value, and binary search places the block inside it.
    """
    in_short, in_long, low = [], [], 0
    for i in range(0, len(short), BLOCK):
        block = short[i : i + BLOCK]
        width = len(block)
        while low + width < len(long) and long[low + width - 1] < block[-1]:
            width *= 2
        bracket = long[low : low + width]
        at = np.searchsorted(bracket, block)
        hit = np.flatnonzero(at < len(bracket))
        hit = hit[bracket[at[hit]] == block[hit]]
        in_short.append(i + hit)
        in_long.append(low + at[hit])
        low += int(at[-1])
    return (np.concatenate(in_short), np.concatenate(in_long)) if in_short else (np.zeros(0, np.int64),) * 2


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of the tokens that end together."""
    if len(a_ends) <= len(b_ends):
        return gallop(a_ends, b_ends)
    return gallop(b_ends, a_ends)[::-1]


def overlaps(ends: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the first and the last token of the other side that shares a byte with it: the rank of
    its start among the other's ends, and the rank of its end."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.searchsorted(other, starts, side="right"), np.searchsorted(other, ends, side="left")


def digest_text(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, names: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the groups that the common ends (places in_a, in_b) cut. names[i] is `,` and i, padded by zero bytes."""
    # A token stands behind the B tokens of the groups before its own, a B token behind all A tokens of its group too.
    group_a = np.searchsorted(in_a, np.arange(len(a)))
    group_b = np.searchsorted(in_b, np.arange(len(b)))
    b_before = np.concatenate([[0], in_b + 1])[group_a]
    a_before = (in_a + 1)[group_b]
    out = np.zeros(len(a) + len(b), names.dtype)
    out[np.arange(len(a)) + b_before] = names[a]
    out[np.arange(len(b)) + a_before] = names[b]
    letters = out.view(np.uint8).reshape(len(out), names.dtype.itemsize)
    first_a, first_b = np.concatenate([[0], in_a[:-1] + 1]), np.concatenate([[0], in_b[:-1] + 1])
    letters[first_a + b_before[first_a], 0] = ord(";")
    letters[first_b + a_before[first_b], 0] = ord("|")
    return out.tobytes().translate(None, b"\0")[1:]


def _aligned(texts: list[str | None], table: WordTable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (ids of A, of B, ends of A, of B, places in A and B of common ends), in groups of bounded length."""
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j] or "") <= GROUP_CHARS):
            chars += len(texts[j] or "")
            j += 1
        words = [_WORD.findall(" " + t) if t else [] for t in texts[i:j]]
        table.learn(set().union(*words))
        for text, own in zip(texts[i:j], words):
            a, b = table.encode(text or "", own)
            a_ends, b_ends = np.cumsum(table.a_size[a]), np.cumsum(table.b_size[b])
            yield a, b, a_ends, b_ends, *common_ends(a_ends, b_ends)
        i = j


def align_tokens(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, a_ids, b_ids, a_stops, b_stops (ends of the groups in either list, exclusive), a_first, a_last
    (for each A token the first and last B token that it overlaps).

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have empty
    lists. Null ids come back null, repeated rows are each aligned, other columns are ignored.
    """
    docs = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    names = ["a_ids", "b_ids", "a_stops", "b_stops", "a_first", "a_last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(load(folder))
        for batch in batches:
            rows = [(a, b, in_a + 1, in_b + 1, *overlaps(a_ends, b_ends)) for a, b, a_ends, b_ends, in_a, in_b in _aligned(batch.column("text").to_pylist(), table)]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), pa.list_(pa.int32())) for c in columns)], names=["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names))


def link_table(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and the document's links as arrays: `pairs` (A id times the
    number of B ids, plus B id; rising) and `times`. Written to the shared folder: later passes need no text."""
    docs = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    n_pieces = len(load(folder).b_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(load(folder))
        names = np.array([f",{i}".encode() for i in range(max(len(table.a_size), len(table.b_size)))])
        for batch in batches:
            rows = []
            for a, b, _, _, in_a, in_b in _aligned(batch.column("text").to_pylist(), table):
                pairs, times = np.unique(a[in_a].astype(np.int64) * n_pieces + b[in_b], return_counts=True)
                digest = hashlib.sha256(digest_text(a, b, in_a, in_b, names)).hexdigest() if len(a) else ""
                rows.append((len(a), len(b), len(in_a), digest, pairs, times))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return save(docs.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"), "links")


def pair_counts(links: DataFrame, n_pieces: int) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold the two ids linked. Equal pairs of a document are one row
    before the shuffle, and map-side sums leave at most one row a task and pair."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy("pairs").agg(F.sum("times").alias("n"))
    return counts.select(F.expr(f"cast(pairs div {n_pieces} AS int)").alias("a_id"), F.expr(f"cast(pairs % {n_pieces} AS int)").alias("b_id"), "n")


def align_documents(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links (pairs of tokens that end together), n_best (links whose count
    is the highest of their B id, ties included), count_sum (of the links' counts) and groups_sha256.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have zeros
    and ''. Null ids come back null, repeated rows are each aligned and counted, other columns are
    ignored, an empty table gives none. The counts reach every task as one table; it holds at most
    Tokenizers.suffix_pairs() rows, a number of the vocabularies, however large the corpus is.
    """
    spark = documents.sparkSession
    vocabularies = load(folder)
    n_pieces = len(vocabularies.b_bytes)
    links = link_table(documents, folder)
    counts = pair_counts(links, n_pieces).toArrow()
    if counts.num_rows > (bound := vocabularies.suffix_pairs()):
        raise AssertionError(f"{counts.num_rows} pairs end together, of at most {bound}")
    key = counts["a_id"].to_numpy().astype(np.int64) * n_pieces + counts["b_id"].to_numpy()
    order = np.argsort(key)
    best = np.zeros(n_pieces, np.int64)
    np.maximum.at(best, counts["b_id"].to_numpy(), counts["n"].to_numpy())
    known = spark.sparkContext.broadcast((key[order], counts["n"].to_numpy()[order], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, top = known.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            n = ns[np.searchsorted(keys, flat)]
            sizes = pairs.value_lengths().to_numpy()
            stops = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (often, often * (n == top[flat % n_pieces]), often * n)]
            made = [pa.array(s[stops] - s[stops - sizes], pa.int64()) for s in sums]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.record_batch([*kept, *made, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return links.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
