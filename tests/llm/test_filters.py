import hashlib
import itertools
import json
import math
import pathlib
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barline.llm import mixing, pii, quality, url_rules
from barline.llm.decontaminate import clean_documents, contaminated, smith_waterman
from barline.llm.licenses import scan_licenses
from barline.llm.sharding import rendezvous_shards, shard_documents

from . import brute

DOCS = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000)) + "."


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash"))


EDGE = [(1, "some words here", "a"), (1, "some words here", "a"), (None, "x y", "b"), (None, None, None), (4, "", "a"), (5, LONG, "b"), (6, "some words here", None)]


def test_shards(spark):
    rows = [(i, f"text {i % 7}", "s") for i in range(2000)] + EDGE
    got = shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        text = {x[0]: x[1] for x in rows if x[0] is not None and x[0] > 6}.get(r.doc_id)
        if text is not None:
            assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text.encode())
            scores = [-1 / math.log(((xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), seed=42)) >> 11) + 0.5) / 2**53) for j in range(41)]
            assert r.shard == int(np.argmax(scores[:40])) and r.grown_shard == int(np.argmax(scores))
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(map(str, got)) == sorted(map(str, shard_documents(docs(spark, rows[::-1])).collect()))
    assert shard_documents(docs(spark, EDGE).filter("false")).count() == 0


def test_weighted_shards(spark):
    n = Counter(r.shard for r in rendezvous_shards(spark.range(20_000), ["id"], [1.0, 3.0]).collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02


def test_targets_fill_by_weight():
    got = mixing.target_words({"a": 100, "b": 10, "c": 100}, {"a": 3.0, "b": 1.0, "c": 2.0}, 1.5, 2)
    assert got["b"] == 20 and abs(sum(got.values()) - 315) < 1e-9 and abs(got["a"] / got["c"] - 1.5) < 1e-9


def test_flow_is_cheapest():
    """Overlapping sources: words that serve both quotas are repeated only where they must be."""
    taken = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15}, 2)
    assert taken == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    taken = mixing.route({("a",): 10, ("b",): 10}, {"a": 15, "b": 5}, 2)
    assert taken == {("a",): 15, ("b",): 5}
    best = min((max(0, x - 6) + max(0, y - 4) + max(0, z - 5), x, y, z) for x in range(13) for y in range(9) for z in range(11) if x + y + z == 20 and x <= 12 and z <= 9 and x + y >= 11)
    taken = mixing.route({("a",): 6, ("a", "b"): 4, ("b",): 5}, {"a": 11, "b": 9}, 2)
    assert sum(max(0, taken[p] - s) for p, s in ((("a",), 6), (("a", "b"), 4), (("b",), 5))) == best[0]


def test_flow_of_many_patterns():
    """Against a linear search over all cuts: the flow is that of the smallest cut, and repeats as little."""
    r = random.Random(3)
    for _ in range(20):
        sources = "abcd"
        patterns = {p: r.randint(1, 30) for p in {tuple(sorted(r.sample(sources, r.randint(1, 3)))) for _ in range(6)}}
        targets = {s: r.randint(0, 60) for s in {x for p in patterns for x in p}}

        def most(copies):
            cuts = []
            for size in range(len(targets) + 1):
                for full in itertools.combinations(targets, size):  # sources whose quota is cut; other patterns are cut whole
                    cuts.append(sum(targets[s] for s in full) + sum(copies * n for p, n in patterns.items() if set(p) - set(full)))
            return min(cuts)

        taken = mixing.route(patterns, targets, 2)
        assert sum(taken.values()) == most(2) and sum(min(taken[p], n) for p, n in patterns.items()) == most(1)


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), r.choice(["a", "a", "a", "b", "é", None])) for i in range(600)] + [(700, "", "a"), (None, None, "b"), (None, "p q", "b"), (600, "same same", "a"), (600, "same same", "a")]
    got = mixing.mix_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, sums, targets = Counter(), Counter(), {}
    source = {d: s for d, _, s in rows}
    for x in got:
        s = source[x.doc_id] if x.doc_id is not None else "b"
        sizes[s] += x["size"]
        sums[s] += x.taken
        targets[s] = x.target
        assert 0 <= x.taken <= 2 * x["size"] and x.taken % max(1, x["size"]) == 0
    want = mixing.target_words(dict(sizes), {s: w for s, w in zip(["a", "b", "é", None], (3.0, 1.0, 2.0, 3.0))}, 1.5, 2)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 and abs(sums[s] - want[s]) <= 40
    again = mixing.mix_documents(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_documents(docs(spark, EDGE).filter("false")).count() == 0


def test_mix_edge_rows(spark):
    assert mixing.mix_documents(docs(spark, EDGE)).count() == len(EDGE)


def naive_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_quality(spark):
    good = "\n".join(f"Line {i} tells a{i} story b{i} of c{i} its d{i} own, plainly e{i}." for i in range(8))
    navigation = "Home | News | About | Contact | Login\n" * 1 + " | ".join(f"item{i}" for i in range(60))
    symbols = " ".join(f"w{i}*** x{i}###" for i in range(40))
    boiler = "\n".join(["All rights reserved.", "Click here to read more."] + [f"Subscribe now to our letter {i}!" for i in range(12)])
    loops = "a b c d e f g h " * 20
    stutter = " ".join(f"{w} {w} {w}" for w in map(str, range(100, 140))) + "."
    cases = [(1, good, True), (2, navigation, False), (3, symbols, False), (4, boiler, False), (5, loops, False), (6, None, False), (7, "", False), (8, "short text.", False), (9, LONG, True), (10, good + "\nHome | News | About", True), (11, stutter, False), (11, stutter, False), (None, good, True)]
    got = quality.quality_rules(docs(spark, [(d, t, "s") for d, t, _ in cases])).collect()
    want = sorted((d or 0, *naive_quality(t), k) for d, t, k in cases)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert next(r for r in got if r.doc_id == 10).clean_text == good
    df = docs(spark, [(d, t, "s") for d, t, _ in cases])
    assert quality.filter_documents(df).columns == df.columns and quality.filter_documents(df).count() == 4
    assert quality.quality_rules(df.filter("false")).count() == 0


def quality_texts(r, n):
    """Lines of every kind, mixed at random."""
    word = lambda: r.choice(["Haus", "été", "the", "a1", "42", "x***", "q!!", "b#", "|", "—", ">", "…", "漢字", "end.", "ok?»", "..."])
    fixed = ["Home | News | About", "All rights reserved.", "Read more!", "", "  ", "\t|", "1 2 3.", "no no no no no no no no yes", "Sign\u00a0in", "同意。", "\x0b\x0c", "LOG IN here"]
    return ["\n".join(r.choice(fixed) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 12))) + r.choice(["", "\n"]) for _ in range(n)]


def test_quality_against_brute_force(spark):
    texts = quality_texts(random.Random(21), 400) + [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {x.doc_id: x for x in quality.quality_rules(docs(spark, [(i, t, str(i)) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == naive_quality(t), t
        assert (x.kept, x.n_lost_words, x.failed_rules, x.clean_text) == brute.quality(t), t


def test_boilerplate_is_learned(spark):
    """A line of one source between different lines goes; one of a copied document, of another
    source, or of few documents stays."""
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    footer, rare = "Our office is open on all days of the week.", "A rare line of this table and nothing else."
    copied = "\n".join(words(9) for _ in range(4))
    rows = []
    for i in range(300):
        lines = [words(15), words(15), words(15)]
        if i % 3 == 0:
            lines.insert(r.randint(0, 3), footer)
        if i % 100 == 0:
            lines.insert(1, rare)
        rows.append((i, "\n".join(lines), ["a", None][i % 3 == 0]))
    rows += [(1000 + i, copied, None) for i in range(40)] + [(2000, words(30) + "\n" + footer, "a")]
    got = {x.doc_id: x for x in quality.quality_rules(docs(spark, rows)).collect()}
    for d, t, s in rows:
        assert (got[d].kept, got[d].n_lost_words, got[d].failed_rules, got[d].clean_text) == brute.quality(t, {footer} if s is None else ()), d
    assert sum(x.failed_rules == "boilerplate" for x in got.values()) == 100


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(4)
    parts = ["a.b@c.d", "@", "x@y", "x@y.z", "10.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111", "+1 (017) 555-7713", "+", "é", "..", "256.1.1.1", "000000000000", "-", "0" * 30, "+1234567890"]
    for _ in range(3000):
        text = r.choice([" ", "", ", "]).join(r.choice(parts) for _ in range(r.randint(0, 7)))
        assert pii.base_spans(text) == naive_spans(text), text


def pii_texts(r, n):
    out = []
    for i in range(n):
        w = [r.choice(["some", "words", "there", "of"]) for _ in range(12)]
        w.insert(4, r.choice([f"u{i}@mail.example.com", f"10.{i % 250}.0.7", f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"in {1900 + i % 100}", "version 2.0", "4111 1111 1111 1111"]))
        out.append(" ".join(w))
    return out


def test_field_learns_held_out_forms():
    r = random.Random(1)
    weights = pii.train(pii_texts(r, 300))
    held = pii_texts(r, 200)
    right = total = 0
    for t in held:  # without the base patterns' help
        found = {(*pii.trimmed(t, w[i][0], w[j - 1][1]), k) for w in pii.regions(t) for i, j, k in pii.decode(weights, pii.candidates(t, w))}
        true = {(a, b, k) for a, k, b in pii.base_spans(t)}
        right += len(found & true)
        total += max(len(found), len(true))
    assert right / total > 0.95
    spans = pii.find_spans("call (017) 555-7713 now", weights)
    assert spans[0] == [] and [(k, b - a) for a, k, b in spans[1]] == [(3, 14)]
    assert pii.find_spans("in 2024 we had 15 cats", weights)[1] == []
    for form in (0, 1):  # recall and precision on forms that no base pattern finds
        got = want = both = 0
        for t in held:
            changed, spans = pii.rewritten(t, form)
            true = {(*pii.trimmed(changed, a, b), k) for a, k, b in spans}
            found = {(a, b, k) for a, k, b in pii.find_spans(changed, weights)[1]}
            got, want, both = got + len(found), want + len(true), both + len(found & true)
        assert both / want > 0.9 and both / got > 0.9


def test_field_without_training():
    for weights in (pii.train([]), [{} for _ in range(5)], [{"words=1": 0.5}] + [{"words=1": 0.5}] * 4):
        assert pii.find_spans("take the dot product of two rows, 12 in all", weights)[1] == []
        assert pii.find_spans("mail a@b.org", weights)[1] == [(5, 0, 12)]


def test_passages_keep_every_word_and_entity():
    r = random.Random(2)
    text = " ".join(pii_texts(r, 200))
    cut = pii.passages(text)
    assert max(len(x.split()) for x in cut) <= pii.PASSAGE_WORDS + pii.MAX_WORDS
    assert sum(len(pii.base_spans(x)) for x in cut) == len(pii.base_spans(text))
    numbers = " ".join(map(str, range(5000)))  # one long region
    assert " ".join(pii.passages(numbers)) == numbers


def test_segmentation_is_best():
    """The dynamic program against all segmentations of a few words."""
    text = "at +1 (974) 555-3436 or u@h.org"
    weights = pii.train(pii_texts(random.Random(1), 60))
    (words,) = pii.regions(text)
    segments = pii.candidates(text, words)
    score = lambda i, n, k: sum(weights[k].get(f, 0.0) for f in segments[i - 1][n - 1][1])

    def best(i):
        if i == 0:
            return 0.0
        return max(best(i - n) + score(i, n, k) for n in range(1, min(pii.MAX_WORDS, i) + 1) for k in range(5) if n == 1 or k)

    chosen, at, total = pii.decode(weights, segments), 0, 0.0
    for a, b, k in [*chosen, (len(words), len(words), 0)]:
        total += sum(score(i + 1, 1, 0) for i in range(at, a)) + (score(b, b - a, k + 1) if b > a else 0)
        at = b
    assert math.isclose(total, best(len(words)), rel_tol=1e-9)


def test_added_spans_against_all_segmentations(spark):
    """The operator's spans against base patterns and a search of all segmentations, on short texts."""
    r = random.Random(12)
    weights = pii.train(pii_texts(r, 120))
    parts = ["(017) 555-7713", "u at h dot org", "10[.]1[.]2[.]3", "word", "7", "x@y.org", "2024", "or"]
    texts = [" ".join(r.choice(parts) for _ in range(3)) for _ in range(40)]

    def all_ways(n):
        if n == 0:
            yield []
        for m in range(1, min(n, pii.MAX_WORDS) + 1):
            for rest in all_ways(n - m):
                for k in range(5):
                    if m == 1 or k:
                        yield [*rest, (n - m, n, k)]

    want = {}
    for i, t in enumerate(texts):
        base, spans = naive_spans(t), []
        for words in pii.regions(t):
            if len(words) > 6:
                break
            score = lambda a, b, k: sum(weights[k].get(f, 0.0) for f in pii.features(t, words[a][0], words[b - 1][1], b - a))  # noqa: E731, B023
            best = max(all_ways(len(words)), key=lambda way: sum(score(*x) for x in way))
            spans += [(*pii.trimmed(t, words[a][0], words[b - 1][1]), k - 1) for a, b, k in best if k]
        else:
            extra = [(a, k, b) for a, b, k in spans if a < b and not any(x < b and a < y for x, _, y in base)]
            want[i] = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + extra))
    got = {x.doc_id: x.spans for x in pii.find_personal_data(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), weights).collect()}
    assert len(want) > 5 and {i: got[i] for i in want} == want


#: What the field must leave alone: dates, amounts, versions, ranges, codes, and words that spell no address.
NO_DATA = ["2024-01-02", "12.05.1987", "1,234.50", "3.14159", "1.2.3", "10-12, 14-16", "90210-1234", "look at the dot product of two", "open from 9:00 to 17:30 on 2023-05-06", "a sum of 12,345,678.90 dollars", "in 2024 we had 15 cats"]


def test_field_on_forms_of_the_given_documents(spark):
    """Fitted on half of the documents; the other half's own entities, rewritten, are found and nothing else is."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weights = pii.fit(table.filter("doc_id % 2 = 0"), 1500)
    hit = want = got = 0
    for (text,) in table.filter("doc_id % 2 = 1 AND text rlike '@'").select("text").limit(150).collect():
        plain = re.sub("[A-Za-z0-9._%+-]+@", lambda m: (re.sub("[^A-Za-z]", "", m[0]) or "mail") + "@", text)  # local parts without digits
        for form in range(4):
            changed, spans = pii.rewritten(plain, form)
            true = {(*pii.trimmed(changed, a, b), k) for a, k, b in spans}
            found = {(a, b, k) for a, k, b in pii.find_spans(changed, weights)[1]}
            hit, want, got = hit + len(true & found), want + len(true), got + len(found)
    assert want > 400 and hit / want > 0.95 and hit / got > 0.95
    for text in NO_DATA:
        assert pii.find_spans(text, weights)[1] == [], text
    for text in ("jane at example dot org", "john [at] example [dot] org", "john dot smith at example dot com", "please write to jane at example dot org at once"):
        assert [k for _, k, _ in pii.find_spans(text, weights)[1]] == [0], text


def test_long_texts_of_addresses_take_seconds(spark):
    text = " ".join(f"u{i}@mail.example.org" for i in range(120_000))
    assert len(text) > 2_500_000
    weights = pii.train(pii_texts(random.Random(1), 60))
    begin = time.perf_counter()
    row = pii.find_personal_data(docs(spark, [(1, text, "s")]), weights).first()
    assert row.n_email == 120_000 and time.perf_counter() - begin < 60
    assert len(pii.passages(text)) >= 120_000 / (pii.PASSAGE_WORDS + 1)


def test_regions_reach_whole_entities():
    text = "a b please write to john dot smith at example dot com at once or never"
    (words,) = pii.regions(text)
    assert text[words[0][0] : words[-1][1]] == "a b please write to john dot smith at example dot com at"
    cover = pii.Cover([(0, 0, 9), (20, 0, 30)])
    assert [cover.meets(a, b) for a, b in ((9, 20), (8, 9), (29, 40), (30, 31), (5, 5), (9, 9))] == [False, True, True, False, True, False]


def test_personal_data(spark):
    rows = [(i, t, "s") for i, t in enumerate(pii_texts(random.Random(3), 40))] + EDGE
    got = pii.find_personal_data(docs(spark, rows)).collect()
    want = []
    for d, t, _ in rows:
        base = naive_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append(str((d, *[sum(k == x for _, k, _ in base) for x in range(4)], hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(want)
    assert pii.find_personal_data(docs(spark, EDGE).filter("false")).count() == 0


def test_url_rules(spark):
    urls = [
        ("http://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("https://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "block"), ("http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://x.org/es", "x.org", "/es", None, "allow"), ("x.org/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://com/en/?a://b", "com", "/en/", "com/en/", "block"),
        ("http://h.com#/en/", "h.com", "", None, "allow"), ("a\nb://Q.org/es/\n1", "q.org", "/es/\n1", "org/es/", "block"), ("http://k.org/" + "p/" * 5000, "k.org", "/" + "p/" * 5000, None, "allow"),
    ]
    pages = spark.createDataFrame([(i if i else None, u[0]) for i, u in enumerate(urls)] + [(1, urls[1][0])], "page_id long, url string").withColumn("host", F.lit(0))
    labels = spark.createDataFrame([(urls[0][0], True), (None, True), (urls[1][0], None)], "url string, bad boolean")
    got = url_rules.filter_urls(pages, labels).collect()
    want = [(i if i else None, *u[1:]) for i, u in enumerate(urls)] + [(1, *urls[1][1:])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_rules.filter_urls(pages.filter("false"), labels.filter("false")).count() == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    """Every rule alone, and the longer one of two that contradict each other; a mined rule changes none of them."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/8": ("net/de/", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://a.example.net/de/81": ("example.net/de/8", "block"), "http://q.org/es/1": ("org/es/", "block"), "http://x.net/de": (None, "block"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    labels = spark.createDataFrame([(f"http://x.net/{i}", True) for i in range(10)] + [(f"http://y.io/{i}", False) for i in range(10)], "url string, bad boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.filter_urls(pages, labels).collect()}
    assert got == dict(enumerate(want.values()))


def test_url_rules_are_mined(spark):
    """Pages of one farm with a query key are bad; held-out ones are found, clean ones are left."""
    r = random.Random(5)

    def url(i):
        bad = i % 4 == 0
        host = "farm.example.dev" if bad or i % 4 == 1 else f"h{i % 9}.example.dev"
        return f"https://{host}/p/{i}" + ("?promo=1" if bad else r.choice(["", "?page=2"])), bad

    made = [(i, *url(i)) for i in range(800)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in made] + [(None, None)], "page_id long, url string").withColumn("tokens", F.lit("clash")).withColumn("bad", F.lit("clash"))
    labels = spark.createDataFrame([(u, b) for _, u, b in made[:400]], "url string, bad boolean")
    got = {r.page_id: r.verdict == "block" for r in url_rules.filter_urls(pages, labels).collect()}
    assert got == {i: b for i, _, b in made} | {None: False}


def test_mined_rules_against_all_combinations(spark):
    """FP-growth, confidence, pruning and index against every combination of tokens."""
    r = random.Random(9)
    rows = []
    for _ in range(300):
        t = sorted(r.sample("abcdefg", r.randint(1, 5)))
        rows.append((t, ({"a", "b"} <= set(t) or "g" in t) != (r.random() < 0.08)))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    n, bad = len(rows), sum(b for _, b in rows)
    some = [x for x in "abcdefg" if sum(b for t, b in rows if x in t) * n > bad * sum(x in t for t, _ in rows)]
    want = {}
    for size in range(1, 6):
        for c in itertools.combinations(some, size):
            of = [b for t, b in rows if set(c) <= set(t)]
            if sum(of) >= max(5, 0.02 * n) and sum(of) / len(of) >= 0.7:
                want[c] = sum(of) / len(of)
    want = {c: v for c, v in want.items() if not any(set(d) < set(c) and w >= v for d, w in want.items())}
    got = {tuple(x.tokens): x.confidence for x in url_rules.mine_rules(labelled, 0.02, 0.7, 1.2).collect()}
    assert want and {c: round(v, 9) for c, v in got.items()} == {c: round(v, 9) for c, v in want.items()}
    held = spark.createDataFrame([(f"http://{'.'.join(t)}.x/", ) for t, _ in rows], "url string").distinct()
    rules = spark.createDataFrame([(i, [f"label={x}" for x in c], f"label={c[0]}", 1.0) for i, c in enumerate(want)], "rule long, tokens array<string>, key string, confidence double")
    hits = {x.url for x in url_rules.blocked_urls(held, rules).collect()}
    assert hits == {x.url for x in held.collect() if any(set(c) <= set(x.url[7:-3].split(".")) for c in want)}


def test_content_labels(spark):
    pages = [("u1", "<p>Casino nights</p>"), ("u2", "<script>casino()</script><a href='casino'>x</a><!-- pills -->"), ("u3", None), (None, "casino"), ("u4", "occasino"), ("u5", "")]
    got = url_rules.content_labels(spark.createDataFrame(pages, "url string, html string")).collect()
    assert sorted((x.url, x.bad) for x in got) == [("u1", True), ("u2", False), ("u4", False), ("u5", False)]


def test_alignment():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 14))] for _ in range(2))
        score, lo, hi = smith_waterman(np.array(a), np.array(b))
        assert math.isclose(score, brute.smith_waterman(a, b)), (a, b)
        assert 0 <= lo <= hi <= len(a)


def test_decontamination(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(24))) for i in range(6)] + [(6, "too short"), (7, None), (8, "")]
    fill = lambda n: " ".join(word() for _ in range(n))
    edited = items[1][1].split()
    edited[5], edited[11] = "changed", "words"
    del edited[17]
    rows = [(1, fill(200) + " " + items[0][1].upper() + " " + fill(90)), (2, fill(30) + " " + " ".join(edited)), (3, fill(300)), (4, " ".join(items[2][1].split()[:6]) + " " + fill(50)), (5, None), (6, ""), (None, items[3][1]), (7, items[4][1]), (7, items[4][1]), (8, fill(20_000) + " " + items[5][1])]
    rows += [(100 + i, items[0][1] + " " + fill(5)) for i in range(40)]
    df = docs(spark, [(d, t, "s") for d, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = {(x.doc_id, x.item_id): x for x in contaminated(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 3), (7, 4), (8, 5)} | {(100 + i, 0) for i in range(40)}
    assert got[(1, 0)].score == 1.0 and (got[(1, 0)].begin, got[(1, 0)].end) == (200, 224) and 0.6 < got[(2, 1)].score < 1
    assert sorted(x.doc_id for x in clean_documents(df, bench).collect()) == [3, 4, 5, 6]
    assert contaminated(df.filter("false"), bench).count() == 0 and contaminated(df, bench.filter("false")).count() == 0


def test_decontamination_against_all_alignments(spark):
    """Every document with every item: edits of 0 to 35 %, halves that are frequent, items side by side."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 24)))) for i in range(8)]
    rows = []
    for d in range(90):
        parts = [word() for _ in range(r.randint(0, 40))]
        for _, t in r.sample(items, r.randint(0, 2)):
            w, share = t.split(), r.choice([0, 0.1, 0.2, 0.25, 0.3, 0.35])
            w = [x for y in w for x in (r.choice([[], [word()], [y, word()]]) if r.random() < share else [y])]
            parts += w + [word() for _ in range(r.randint(0, 12))]
        if d % 3 == 0:
            parts += items[0][1].split()[: len(items[0][1].split()) // 2 + 2]
        rows.append((d, " ".join(parts)))
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    want = {}
    for d, t in rows:
        for i, item in items:
            score = brute.smith_waterman(t.split(), item.split())
            if score >= 0.5 and grams(t.split()) & grams(item.split()):
                want[d, i] = round(score, 6)
    got = {(x.doc_id, x.item_id): x.score for x in contaminated(docs(spark, [(d, t, "s") for d, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and got == want


def test_a_phrase_of_many_items_pairs_nothing(spark, monkeypatch):
    """Items that share a question phrase, and documents that hold it without any item: no alignment is tried.
    An edited copy among them, and one of an item that is mostly the phrase, are still found."""
    from barline.llm import decontaminate

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    phrase = "which of the following is the best answer to"
    items = [(i, f"{phrase} {' '.join(word() for _ in range(12))}") for i in range(60)] + [(60, f"{phrase} all"), (61, " ".join(word() for _ in range(400)))]
    rows = [(d, f"{' '.join(word() for _ in range(20))} {phrase} {' '.join(word() for _ in range(20))}") for d in range(400)]
    copy = items[7][1].split()
    copy[3], copy[13] = "other", "words"
    rows += [(1000, f"some text {' '.join(copy)} and more"), (1001, f"x {items[61][1]} y")]
    pairs = []
    save = decontaminate.save

    def counted(df, name):
        out = save(df, name)
        if name == "passages":
            pairs.append(out.select(F.sum(F.size("keys"))).first()[0])
        return out

    monkeypatch.setattr(decontaminate, "save", counted)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in contaminated(docs(spark, [(d, t, "s") for d, t in rows]), bench).collect()}
    assert {k for k in got if k[1] != 60} == {(1000, 7), (1001, 61)} and got[1001, 61] == 1.0
    assert {d for d, i in got if i == 60} == {d for d, _ in rows} - {1001}  # nine of its ten words are the phrase
    got = {(x.doc_id, x.item_id) for x in contaminated(docs(spark, [(d, t, "s") for d, t in rows]), bench.filter("item_id <> 60")).collect()}
    assert got == {(1000, 7), (1001, 61)} and pairs[1] < 1000


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/x.py", "print(1)"), (3, "a/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/c/d/y.py", None), (5, "z/y.py", ""), (6, "a/b/z.py", "Licensed under CC BY-NC 4.0.\n" + "code " * 90),
        (7, None, "Released under the MIT License."), (8, None, "nothing"), (9, "top.py", "x"), (2, "a/b/x.py", "print(1)"), (None, "a/q", "it was " * 9000),
    ]
    return spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))


def test_licenses(spark, files):
    got = sorted((str(r.doc_id), r.license, r.origin, r.from_dir) for r in scan_licenses(files).collect())
    assert got == sorted([
        ("1", "MIT", "file", None), ("2", "MIT", "inherited", "a"), ("2", "MIT", "inherited", "a"), ("3", "Apache-2.0", "file", None), ("4", "Apache-2.0", "inherited", "a/c"), ("5", None, "none", None),
        ("6", "CC-BY-NC-4.0", "header", None), ("7", "MIT", "file", None), ("8", None, "none", None), ("9", None, "none", None), ("None", "MIT", "inherited", "a"),
    ], key=str)
    assert scan_licenses(files.filter("false")).count() == 0


def test_full_licence_texts(spark):
    """Whole licence texts are found under their own names among files that only mention licences."""
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL": "GFDL-1.3", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = [(i, f"{n}/LICENSE", (folder / n).read_text()) for i, n in enumerate(names)] + [(100 + i, f"{n}/src/deep/x.c", "int x;") for i, n in enumerate(names)] + [(200, "prose/LICENSE", "A licence to tell stories.\n\nNo more than that.")]
    got = {r.path: (r.license, r.origin, r.from_dir) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {f"{n}/LICENSE": (k, "file", None) for n, k in names.items()} | {f"{n}/src/deep/x.c": (k, "inherited", n) for n, k in names.items()} | {"prose/LICENSE": (None, "none", None)}
    assert got == want
