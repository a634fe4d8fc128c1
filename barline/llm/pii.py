"""Personal data: exact base patterns, and a semi-Markov conditional random field beside them.

The field splits the words around digits and @ signs into segments of bounded length; features
of the whole span score each candidate segment, and one dynamic program chooses boundaries
and types together. It is trained here, on the base patterns' spans in a bounded sample of
passages and on rewritten forms of them that the patterns miss. An entity of over MAX_WORDS
words is no candidate, neither in training nor in use.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Words of the longest entity that the field considers (an address spelt out with three dots in it).
MAX_WORDS = 9
#: Passages that the field is fitted on: those of smallest seeded hash around a digit or @.
SAMPLE_PASSAGES = 3000
#: Words of a training passage; a longer region is cut between entities, none is left out.
PASSAGE_WORDS = 30
EPOCHS = 6
#: Words of all training regions, rewritten ones included: passages beyond them are not trained on, so that
#: passages full of personal data take no longer than others.
SAMPLE_WORDS = 100_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]|\bdot\b")
_SPELT = re.compile(r"\bdot\b")
_DIGITS = re.compile(r"[0-9]+")
_NON_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail matches, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns' matches, by start then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NON_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


class Cover:
    """Spans, sorted by start: whether one of them meets a range, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def regions(text: str, base: Cover | None = None) -> list[list[tuple[int, int]]]:
    """Runs of words near a digit, an @ or a spelt dot, as word spans: two words on either side, and before a
    spelt dot as many as an entity can have. Words that `base` covers are in none."""
    if not _TRIGGER.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    free = [base is None or not base.meets(a, b) for a, b in words]
    near = bytearray(len(words))
    wall = 0
    for i, (a, b) in enumerate(words):
        if not free[i]:
            wall = i + 1
        elif _TRIGGER.search(text, a, b):
            back = MAX_WORDS - 1 if _SPELT.search(text, a, b) else 2
            for j in range(max(i - back, wall), min(i + 3, len(words))):
                near[j] = 1
    out: list[list[tuple[int, int]]] = []
    for i, span in enumerate(words):
        if near[i] and free[i]:
            if i and near[i - 1] and free[i - 1]:
                out[-1].append(span)
            else:
                out.append([span])
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without punctuation that never opens or closes an entity."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def spelt(words: list[str]) -> bool:
    """name (dot name)* at name (dot name)+, at and dot bare or in brackets."""
    bare = [w.strip("[]()") for w in words]
    if len(bare) % 2 == 0 or "at" not in bare[1::2]:
        return False
    joints, at = bare[1::2], bare[1::2].index("at")
    return at < len(joints) - 1 and all(x == "dot" for i, x in enumerate(joints) if i != at) and all(w[:1].isalnum() and w not in ("at", "dot") for w in bare[::2])


def features(text: str, a: int, b: int, words: int) -> tuple[str, ...]:
    """Features of a whole candidate span."""
    a, b = trimmed(text, a, b)
    s = text[a:b]
    digits = _NON_DIGIT.sub("", s)
    groups = _DIGITS.findall(s)
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    local, at, domain = s.partition("@")
    out = [f"words={words}", f"digits={n if n < 20 else 20}", f"letters={min(letters, 3)}", f"groups={len(groups) if len(groups) < 7 else 7}"]
    if at:
        out += ["at", "at.domain" if "." in domain.strip(".") and local and " " not in s else "at.other"]
    if words > 4 and spelt(s.split()):
        tail = len(s.rsplit(None, 1)[-1])
        out += ["spelt", f"tail={tail if tail < 5 else 5}"]
    if not letters and n:
        out.append("shape=" + "-".join(str(len(g)) for g in groups[:6]))
        seps = set(_DIGITS.sub("", s))
        out += [f"sep={c}" for c in sorted(seps)] + ["solid" if not seps else "split"]
        if 12 <= n <= 19:
            out.append("luhn" if luhn(digits) else "notluhn")
        if len(groups) == 4 and len(set(_DIGITS.split(s)[1:-1])) == 1:
            out.append("quad" if all(len(g) < 4 and int(g) < 256 for g in groups) else "notquad")
    if s and s[0] in "+(":
        out.append("opens" + s[0])
    if a and text[a - 1] in "\"'=":
        out.append("quoted")
    return tuple(out)


def candidates(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, tuple[str, ...]]]]:
    """For each word, the segments that end there: (words, features)."""
    return [[(n, features(text, words[i + 1 - n][0], words[i][1], n)) for n in range(1, min(MAX_WORDS, i + 1) + 1)] for i in range(len(words))]


#: Label 0 is outside (one word); label k is KINDS[k - 1].
Weights = list[dict[str, float]]


def _scores(weights: Weights, segments) -> list[list[tuple[int, list[float]]]]:
    none = -math.inf
    return [[(n, [sum(w.get(f, 0.0) for f in fs) if n == 1 or k else none for k, w in enumerate(weights)]) for n, fs in ends] for ends in segments]


def decode(weights: Weights, segments) -> list[tuple[int, int, int]]:
    """Best segmentation: (first word, end word, kind index) of its entities. Ties go to "outside", then
    to the earlier kind and the shorter segment; a field that was not fitted finds nothing."""
    if not any(weights):
        return []
    best, back = [0.0], [(0, 0)]
    for i, ends in enumerate(_scores(weights, segments), 1):
        score, k, n = max((best[i - n] + s, -k, -n) for n, row in ends for k, s in enumerate(row) if s > -math.inf)
        best.append(score)
        back.append((-n, -k))
    out, i = [], len(segments)
    while i:
        n, k = back[i]
        if k:
            out.append((i - n, i, k - 1))
        i -= n
    return out[::-1]


def _gradient(weights: Weights, segments, gold: set[tuple[int, int, int]], rate: float) -> None:
    """One step up the log-likelihood of a region: observed less expected segment features."""
    scores = _scores(weights, segments)
    size = len(segments)

    def total(x: list[float]) -> float:
        top = max(x)
        return top + math.log(sum(math.exp(v - top) for v in x)) if top > -math.inf else top

    ahead = [0.0]
    for i, ends in enumerate(scores, 1):
        ahead.append(total([ahead[i - n] + s for n, row in ends for s in row]))
    behind = [-math.inf] * size + [0.0]
    terms: list[list[float]] = [[] for _ in range(size)]
    for i in range(size, 0, -1):
        if i < size:
            behind[i] = total(terms[i])
        for n, row in scores[i - 1]:
            terms[i - n] += [behind[i] + s for s in row]
    for i, (ends, row_scores) in enumerate(zip(segments, scores), 1):
        for (n, fs), (_, row) in zip(ends, row_scores):
            for k, s in enumerate(row):
                if s == -math.inf:
                    continue
                step = ((i - n, i, k) in gold) - math.exp(min(0.0, ahead[i - n] + s + behind[i] - ahead[size]))
                if abs(step) > 1e-4:
                    for f in fs:
                        weights[k][f] = weights[k].get(f, 0.0) + rate * step


def labelled(text: str, found: list[tuple[int, int, int]]) -> list[tuple[list, set[tuple[int, int, int]]]]:
    """Training regions of a text with the given spans as the true segmentation."""
    out = []
    kinds = {trimmed(text, a, b): k for a, k, b in reversed(found)}
    for words in regions(text):
        gold, i = set(), 0
        while i < len(words):
            entity = None
            for n in range(min(MAX_WORDS, len(words) - i), 0, -1):
                kind = kinds.get(trimmed(text, words[i][0], words[i + n - 1][1]))
                if kind is not None:
                    entity = (n, kind + 1)
                    break
            n, k = entity or (1, 0)
            gold.add((i, i + n, k))
            i += n
        out.append((candidates(text, words), gold))
    return out


def plain_address(address: str, labels: int = 2) -> str:
    """The address with the letters of its local part and the last labels of its domain alone."""
    local, _, domain = address.partition("@")
    return (re.sub("[^A-Za-z]+", "", local) or "mail") + "@" + ".".join(domain.split(".")[-labels:])


#: How each kind is rewritten for training: forms that its base pattern misses.
REWRITES = {
    0: (
        lambda x: x.replace("@", " at ").replace(".", " dot "), lambda x: x.replace("@", " [at] ").replace(".", " [dot] "),
        lambda x: plain_address(x).replace("@", " at ").replace(".", " dot "), lambda x: plain_address(x).replace("@", " [at] ").replace(".", " [dot] "),
        lambda x: plain_address(x, 3).replace("@", " at ").replace(".", " dot "), lambda x: plain_address(x, 3).replace("@", " (at) ").replace(".", " (dot) "),
        lambda x: x[:1] + "." + plain_address(x).replace("@", " at ").replace(".", " dot "),
    ),
    1: (lambda x: x.replace(".", "[.]"), lambda x: x.replace(".", "-")),
    2: (lambda x: re.sub("[ -]", ".", x), lambda x: ".".join(re.findall(".{1,4}", re.sub("[ -]", "", x)))),
    3: (lambda x: x.split(" ", 1)[-1] if " " in x else x[1:], lambda x: re.sub("[ ()-]+", ".", x[1:]).strip(".")),
}


#: What is no personal data, made from the digits of what is: dates, times, amounts, versions, ranges, codes.
DECOYS = (
    lambda d: f"20{d[:2]}-{int(d[2:4]) % 12 + 1:02}-{int(d[4:6]) % 28 + 1:02}",
    lambda d: f"{int(d[:2]) % 28 + 1:02}.{int(d[2:4]) % 12 + 1:02}.19{d[4:6]}",
    lambda d: f"{int(d[:2]) % 12 + 1}/{int(d[2:4]) % 28 + 1}/20{d[4:6]}",
    lambda d: f"{int(d[:2]) % 24:02}:{int(d[2:4]) % 60:02}:{int(d[4:6]) % 60:02}",
    lambda d: f"{int(d[0]) + 1},{d[1:4]}.{d[4:6]}",
    lambda d: f"${int(d[0]) + 1},{d[1:4]},{d[4:7]}",
    lambda d: f"{int(d[:2]) + 1},{d[2:5]},{d[5:8]}.{d[:2]}",
    lambda d: f"{d[0]}.{d[1:6]}",
    lambda d: f"{d[0]}.{d[1]}.{d[2:4]}",
    lambda d: f"v{d[0]}.{d[1:3]}",
    lambda d: f"{d[:2]}-{int(d[:2]) + 2}, {d[2:4]}-{int(d[2:4]) + 3}",
    lambda d: f"{d[:5]}-{d[3:7]}",
    lambda d: f"19{d[:2]}-20{d[2:4]}",
    lambda d: f"no. {d[:6]}",
    lambda d: f"{d[:3]} {d[3:6]}",
    lambda d: f"{d[:2]}%",
    lambda d: "look at the dot product",
    lambda d: "met at a dot matrix",
    lambda d: f"978-{d[0]}-{d[1:3]}-{d[3:8]}{d[0]}-{d[1]}",
)


def rewritten(text: str, form: int = 0, decoys: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """(the same text with its personal data in forms that the base patterns miss, their spans), or with
    what is none in its place, and no spans."""
    out, spans, end, size = [], [], 0, 0
    for a, k, b in base_spans(text):
        if a < end:
            continue
        if decoys:
            seed = int.from_bytes(hashlib.sha256(f"{form}:{text[a:b]}".encode()).digest()[:8])
            new = DECOYS[(form + len(spans)) % len(DECOYS)](f"{seed % 10**8:08}")
        else:
            new = REWRITES[k][form % len(REWRITES[k])](text[a:b])
        out += [text[end:a], new]
        size += a - end
        spans.append((size, k, size + len(new)))
        size, end = size + len(new), b
    return "".join([*out, text[end:]]), [] if decoys else spans


def passages(text: str) -> list[str]:
    """The regions of a text, cut between entities to about PASSAGE_WORDS words."""
    found = Cover(base_spans(text))
    out = []
    for words in regions(text):
        first = 0
        for i in range(1, len(words) + 1):
            inside = i < len(words) and found.meets(words[i][0], words[i][0])
            if i == len(words) or (i - first >= PASSAGE_WORDS and not inside):
                out.append(text[words[first][0] : words[i - 1][1]])
                first = i
    return out


def fit(documents: DataFrame, sample: int = SAMPLE_PASSAGES) -> Weights:
    """Train on at most `sample` distinct passages of all documents, chosen by a seeded hash. Only the
    passages reach the driver; documents without a digit or @ give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                found = [x for t in batch.column("text").slice(a, 500) for x in passages(t.as_py())]
                yield pa.record_batch([pa.array(found, pa.string())], names=["passage"])

    near = documents.filter(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(run, "passage string")
    chosen = near.select(F.xxhash64("passage", F.lit(11)).alias("u"), "passage").groupBy("u").agg(F.min("passage").alias("passage"))
    return train([r.passage for r in chosen.orderBy("u").limit(sample).collect()])


def train(texts: list[str]) -> Weights:
    """Weights from passages with their base spans, from the passages rewritten, and from the passages with decoys."""
    data: list = []
    words = 0
    for i, text in enumerate(texts):
        if words > SAMPLE_WORDS:
            break
        before = len(data)
        data += labelled(text, base_spans(text))
        changed, spans = rewritten(text, i)
        if spans:
            data += labelled(changed, spans)
            changed, _ = rewritten(text, i // 2, decoys=True)
            data += labelled(changed, base_spans(changed))
        words += sum(len(segments) for segments, _ in data[before:])
    weights: Weights = [{} for _ in range(len(KINDS) + 1)]
    for epoch in range(EPOCHS):
        for segments, gold in data:
            _gradient(weights, segments, gold, 0.2 / (1 + epoch))
    return weights


def find_spans(text: str, weights: Weights) -> tuple[list, list]:
    """(base spans, all spans) of a text: the field's entities join where no base span overlaps."""
    base = base_spans(text)
    extra, cover = [], Cover(base)
    for words in regions(text, cover):
        for i, j, k in decode(weights, candidates(text, words)):
            a, b = trimmed(text, words[i][0], words[j - 1][1])
            if a < b:
                extra.append((a, k, b))
    return base, sorted(base + extra)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(documents: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256 and spans (base and field).

    Offsets count code points, ends are exclusive. Null and empty texts have no spans. Null ids
    come back null, repeated rows are each judged, extra columns are ignored. One pass to fit, one to
    find. Where several kinds' base spans share a start, they come in the order of KINDS.
    """
    docs = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    model = documents.sparkSession.sparkContext.broadcast(fit(docs) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, spans = find_spans(text.as_py() or "", model.value)
                count = [sum(k == x for _, k, _ in base) for x in range(4)]
                rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
