"""Secret scans over an incremental blob ledger.

Every version of every path is named by the SHA-256 of its text (its blob). The ledger holds which
rule versions have seen which blob and what they found; only unseen pairs of blob and rule version are
scanned, each once however many paths and versions share the blob, and findings are joined back to
all of them. Ledger rows are facts that never change: a repeated or half-committed append adds
nothing wrong, so a scan that dies is simply run again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_sketch, repeated_sketch, save, shared_dir, small_batches


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of `pattern` whose group `group` has `least` characters or more. A changed rule
    takes a new version, so that it is run over every blob again."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """Letters in either case, spelt out: no engine then folds in letters of other alphabets."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Forms that the base rules have no kind for: key blocks, hosting and chat tokens, credentials in addresses.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hosting", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"[a-z]{2,12}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,128}@"),
)
RULES = BASE + MORE

LEDGER = "blob binary, scanned array<string>, found array<struct<rule: string, start: int, end: int>>"


def scan(text: str, rules: Sequence[Rule]) -> list[tuple[int, int, int]]:
    """(start, index of the rule, end) of all matches in a text, by start and then in the rules' order."""
    out = []
    for i, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def blob_of(text: Column) -> Column:
    """The content address of a text; a null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every appended fact. Before the first append the ledger is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(root)


def folded(ledger: DataFrame) -> DataFrame:
    """One row a blob: the rule versions that have seen it, and their findings, each once. A group holds one row for each
    scan of the blob, at most as many as there were rule versions (more only where scans ran side by side)."""
    once = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("scanned", "found")]
    return ledger.groupBy("blob").agg(*once)


def _scanned(rows: DataFrame, rules: Sequence[Rule], skip=None) -> DataFrame:
    """Ledger rows for (blob, text, h) and, where there is one, `todo`: the names of the rules to run. `skip` holds hashes
    of blobs that are not taken here."""
    by_name = {r.name: i for i, r in enumerate(rules)}
    every = list(by_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skip is not None:
                batch = batch.filter(pa.array(~in_sketch(skip.value, batch.column("h").to_numpy().view("uint64"))))
            names = batch.column("todo").to_pylist() if "todo" in batch.schema.names else [every] * len(batch)
            found = []
            for text, own in zip(batch.column("text"), names):
                chosen = [rules[i] for i in sorted(map(by_name.__getitem__, own))]
                found.append([{"rule": chosen[i].name, "start": a, "end": b} for a, i, b in scan(text.as_py() or "", chosen)])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column("blob"), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "scanned", "found"])

    return rows.mapInArrow(run, LEDGER)


def scan_unseen(versions: DataFrame, root: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at `root` has not seen of the texts of `versions`, append it there, and return the pairs
    that were open: blob, n (rows that hold it), todo (names of rule versions).

    A blob that is new and stands in one row is scanned where that row is read; only blobs of several
    rows, or with some rules done, move their text, once a task at most. Both ways are kept apart by
    sketches whose errors send a blob to the exact join and never past it. Null texts are the empty
    blob, repeated rows one blob; an empty table appends nothing.
    """
    spark = versions.sparkSession
    texts = versions.select(blob_of(F.col("text")).alias("blob"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("blob"))
    counted = texts.groupBy("blob", "h").agg(F.count("*").alias("n"))
    seen = folded(read_ledger(spark, root).select("blob", "scanned", "found")).select("blob", "scanned")
    names = F.array(*(F.lit(r.name) for r in rules))
    state = save(
        counted.join(seen, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("scanned", F.expr("cast(array() AS array<string>)")))).drop("scanned"),
        "blobs",
    )
    todo = state.filter(F.size("todo") > 0)
    elsewhere = (F.col("n") > 1) | (F.size("todo") < len(rules))
    open_, moved = (spark.sparkContext.broadcast(repeated_sketch(x, "h")) for x in (todo, state.filter(elsewhere)))

    @F.pandas_udf("boolean")
    def moves(h):
        import pandas as pd

        values = h.to_numpy().view("uint64")
        return pd.Series(in_sketch(moved.value, values) & in_sketch(open_.value, values))

    shared = texts.filter(moves("h")).dropDuplicates(["blob"]).join(todo.select("blob", "todo"), "blob").select("blob", "text", "h", "todo")
    with small_batches(spark):
        _scanned(texts, rules, moved).unionByName(_scanned(shared, rules)).write.mode("append").parquet(root)
    return todo.select("blob", "n", "todo")


def findings_of(versions: DataFrame, root: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `versions` (other columns than text kept) with `found`: the findings of the given rule versions in
    their blob, by start and then in the rules' order; empty where there are none."""
    spark = versions.sparkSession
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    wanted = F.filter("found", lambda x: x["rule"].isin([r.name for r in rules]))
    placed = F.array_sort(F.transform(wanted, lambda x: F.struct(x["start"].alias("start"), order[x["rule"]].alias("at"), x["end"].alias("end"), x["rule"].alias("rule"))))
    # Written first: a join of two shuffles is then split where a blob has very many rows.
    known = save(folded(read_ledger(spark, root).filter(F.size("found") > 0)).select(F.col("blob").alias("__blob"), placed.alias("__found")), "findings")
    rows = versions.withColumn("__blob", blob_of(F.col("text"))).drop("text", "found")
    joined = rows.join(known, "__blob", "left")
    return joined.withColumn("found", F.coalesce("__found", F.expr("cast(array() AS array<struct<start: int, at: int, end: int, rule: string>>)"))).drop("__blob", "__found")


def scan_history(versions: DataFrame, root: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with every version, and return one row for each finding in each of them: the columns
    of `versions` without its text, and kind, rule_version, start, end (code points, end exclusive)."""
    scan_unseen(versions, root, rules)
    each = findings_of(versions, root, rules).withColumn("__f", F.explode("found")).drop("found")
    name = F.split("__f.rule", "@")
    return each.withColumns({"kind": name[0], "rule_version": name[1].cast("int"), "start": F.col("__f.start"), "end": F.col("__f.end")}).drop("__f")


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.split(x["rule"], "@")[0], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base findings), base_sha256 and spans (base and other rules).

    Without a ledger's folder a new one in the shared folder is filled. Offsets count code points, ends
    are exclusive. Null and empty texts have no spans, null ids come back null, repeated rows are each
    returned, other columns are ignored, an empty table gives none.
    """
    docs = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    root = root or f"{shared_dir(documents.sparkSession)}/barline/ledger-{uuid.uuid4().hex}"
    scan_unseen(docs, root)
    base = [r.name for r in BASE]
    names = F.transform("found", lambda x: x["rule"])
    counts = [(F.size(names) - F.size(F.array_remove(names, r.name))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    digest = F.sha2(spans_text(F.filter("found", lambda x: x["rule"].isin(base))), 256).alias("base_sha256")
    return findings_of(docs, root).select("doc_id", *counts, digest, spans_text(F.col("found")).alias("spans"))


def secrets_sql() -> str:
    """The same rows from DuckDB: matches and the gaps between them give the places."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for i, r in enumerate(RULES):
        parts.append(
            f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, string_split_regex(t, {quoted(r.pattern)}) AS gaps, {r.least} AS least FROM docs"
        )
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
each AS (SELECT doc_id, k, kind, least, m[i] AS m, g[i] AS g, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM matched WHERE len(m) > 0)),
spans AS (SELECT doc_id, k, kind, s, kind || ':' || s || ':' || (s + length(m)) AS span FROM each WHERE length(g) >= least),
folded AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))}, string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN folded USING (doc_id)"""
