"""Queries of the message operators over conversations, documents, pages and event properties."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import add_seconds
from ..functions.text import SECRET_NAMES, canonical_json, has_secret, is_canonical_uuid, is_utc_z, normalize_key, normalize_path, normalize_paths, result_id, secret_pattern, sha256_text, uri_fault, uuid5
from ..operators import messages
from ..sources.staging import shared_folder
from ..sources.tables import DECISIONS, put_decisions
from ..streaming.ingest import MESSAGES, ingest_batch
from .bars import flat, instant, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return register


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sha256_text(F.col("text")).alias("sha256"))


_BATCH = """
stored AS (SELECT CAST(conv_id AS VARCHAR) AS id, min(sha256(text)) AS stored_hash FROM conversations WHERE turn = 0 AND conv_id % 3 = 0 GROUP BY conv_id),
batch AS (SELECT CAST(conv_id AS VARCHAR) AS id, sha256(text) AS canonical_hash, turn AS arrival FROM conversations),
firsts AS (SELECT id, first(canonical_hash ORDER BY arrival, canonical_hash) AS first_hash, min(arrival) AS first_at FROM batch GROUP BY id),
classified AS (SELECT b.id, b.canonical_hash, b.arrival, s.stored_hash, CASE WHEN s.id IS NULL AND b.arrival = f.first_at THEN 'accepted' WHEN b.canonical_hash = coalesce(s.stored_hash, f.first_hash) THEN 'duplicate' ELSE 'integrity_conflict' END AS outcome
    FROM batch b JOIN firsts f USING (id) LEFT JOIN stored s USING (id))"""


def _classified(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), sha256_text(F.col("text")).alias("canonical_hash"), F.col("turn").alias("arrival"), "conv_id")
    stored = c.filter("arrival = 0 AND conv_id % 3 = 0").select("id", "canonical_hash")
    return messages.classify_messages(c.drop("conv_id"), stored)


@query("WITH " + _BATCH + " SELECT id, canonical_hash, arrival, outcome FROM classified")
def classify_messages(spark, sf_dir):
    return _classified(spark, sf_dir).select("id", "canonical_hash", "arrival", "outcome")


@query("WITH " + _BATCH + " SELECT outcome, count(*) AS messages FROM classified GROUP BY outcome")
def ingest_outcomes(spark, sf_dir):
    return messages.ingest_outcomes(_classified(spark, sf_dir))


_TOKEN = r"(?im)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|private[_-]?key|seed[_-]?phrase|token)\s*[:=]\s*[^<\s][^\s]*"


@query(rf"""SELECT doc_id, regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') OR regexp_matches(text, '{_TOKEN.replace("|token", "")}') AS secret, regexp_matches(text, '{_TOKEN}') AS token FROM documents""")
def secret_scan(spark, sf_dir):
    """The fixed secret names, and those with `token` added."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", has_secret(F.col("text")).alias("secret"), F.col("text").rlike(secret_pattern((*SECRET_NAMES, "token"))).alias("token"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter(['k', 'page', 'ref'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'page', 'ref'))), ',') AS extra FROM events""")
def json_exact_keys(spark, sf_dir):
    x = messages.exact_keys(F.col("props"), ["k", "page", "ref"])
    return table(spark, sf_dir, "events").select("event_id", x["missing"].alias("missing"), x["extra"].alias("extra"))


#: Forbidden names in the forms that JSON can give them: as JSON text, and as SQL.
_FORBIDDEN = [("API-Key", "'API-Key'"), ("Secret Key", "'Secret Key'"), (r"api\"key", """'api"key'"""), (r"api\\key", r"'api\key'"), (r"api\nkey", "'api' || chr(10) || 'key'"), (r"\u0061pi\u0001\u006bey", "'api' || chr(1) || 'key'"), (r"\tSecret\t/Key\"", """chr(9) || 'Secret' || chr(9) || '/Key"'""")]


@query("SELECT event_id, '$.meta[0].' || CASE event_id // 7 % 7 " + " ".join(f"WHEN {i} THEN {name}" for i, (_, name) in enumerate(_FORBIDDEN)) + " END AS path FROM events WHERE event_id % 7 = 0")
def forbidden_keys(spark, sf_dir):
    """Event properties wrapped in a nested object; every seventh carries a forbidden name, plain or with
    quotes, back slashes, line breaks and other escaped characters in it."""
    forms = F.array(*[F.lit(x) for x, _ in _FORBIDDEN])
    name = F.when(F.col("event_id") % 7 != 0, F.lit(r"pl\"ain")).otherwise(forms[(F.floor(F.col("event_id") / 7) % 7).cast("int")])
    e = table(spark, sf_dir, "events").withColumn("json", F.concat(F.lit('{"meta": [{"'), name, F.lit('": "a \\\\\\"token\\\\\\": b"}], "props": '), F.coalesce("props", F.lit("{}")), F.lit("}")))
    return messages.forbidden_keys(e, "json", ["event_id"])


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS normal FROM pages""")
def normalized_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize_key(F.col("url")).alias("normal"))


@query(r"""SELECT page_id, CASE WHEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('file', 'https', 'git') THEN 'uri_scheme' WHEN page_id % 5 = 0 THEN 'uri_parameter' END AS fault FROM (SELECT page_id, url AS u FROM pages)""")
def uri_policy(spark, sf_dir):
    """Page urls, every fifth with a forbidden query parameter in front."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^([^?#]*)", 1)
    url = F.when(F.col("page_id") % 5 == 0, F.concat(host, F.lit("?Api-Key=1"))).otherwise(F.col("url"))
    return p.select("page_id", uri_fault(url).alias("fault"))


_PATHS = r"""
paths AS (SELECT page_id AS id, rtrim(regexp_extract(url, '://([^?#]*)', 1), '/') AS path FROM pages),
a AS (SELECT DISTINCT id, path FROM paths WHERE id % 50 = 0), b AS (SELECT DISTINCT id, path FROM paths)"""


@query("WITH " + _PATHS + " SELECT a.id AS left_id, a.path AS left_path, b.id AS right_id, b.path AS right_path FROM a JOIN b ON a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')")
def path_overlaps(spark, sf_dir):
    """Every page whose id is divisible by 50, as queries, against all pages."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), normalize_path(F.regexp_extract("url", r"://([^?#]*)", 1)).alias("path"))
    return messages.path_overlaps(p.filter("id % 50 = 0"), p)


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY turn DESC, conv_id DESC LIMIT 25")
def newest_n(spark, sf_dir):
    return messages.newest(table(spark, sf_dir, "conversations"), "turn", "conv_id").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_version(spark, sf_dir):
    return messages.latest_version(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn = 1")
def version_one(spark, sf_dir):
    return messages.as_version(table(spark, sf_dir, "conversations"), F.lit(1), "turn").select("conv_id", "turn", "role", "text")


@query("""SELECT user_id, event_id, version, highest_before FROM (SELECT user_id, event_id, CAST(event_id % 10 AS INTEGER) AS version, max(CAST(event_id % 10 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM events) WHERE version <= highest_before OR version < 1""")
def version_faults(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 10).cast("int").alias("version"))
    return messages.version_faults(e, "user_id", "event_id").select("user_id", "event_id", "version", "highest_before")


@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS id, min(length(text)) % 3 AS lane FROM conversations WHERE role = 'user' GROUP BY conv_id),
    r AS (SELECT CAST(conv_id AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS result_id, turn % 3 AS lane FROM conversations WHERE role = 'assistant')
    SELECT t.id, count(result_id) AS results, min(result_id) AS first_result, count(*) FILTER (result_id IS NOT NULL AND t.lane <> r.lane) AS mismatches, count(result_id) > 1 AS conflict FROM t LEFT JOIN r USING (id) GROUP BY t.id""")
def correlate_results(spark, sf_dir):
    """Conversations as tasks and their answers as results, which should agree on a lane."""
    c = table(spark, sf_dir, "conversations")
    tasks = c.filter("role = 'user'").groupBy(F.col("conv_id").cast("string").alias("id")).agg((F.min(F.char_length("text")) % 3).alias("lane"))
    results = c.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("correlation_id"), (F.col("turn") % 3).cast("int").alias("lane"))
    return messages.correlate_results(tasks, results, ("lane",))


_QUEUE = """
q AS (SELECT event_id AS id, event_type AS lane, ts AS created_at, 'inbound' AS direction, CASE WHEN event_id % 3 = 0 THEN 'processing' ELSE 'received' END AS status, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY END AS lease_until, CAST(1 AS BIGINT) AS revision FROM events),
n AS (SELECT max(ts) - INTERVAL 10 DAY AS now FROM events)"""


def _queue(spark, sf_dir) -> tuple[DataFrame, object]:
    e = table(spark, sf_dir, "events").withColumn("t", instant("ts"))
    now = F.timestamp_micros(F.lit(e.agg(F.unix_micros(F.max("t"))).first()[0] - 10 * 86_400_000_000))
    q = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("lane"), F.col("t").alias("created_at"), F.lit("inbound").alias("direction"), F.when(F.col("event_id") % 3 == 0, "processing").otherwise("received").alias("status"), F.when(F.col("event_id") % 4 == 0, add_seconds(F.col("t"), 86_400)).alias("lease_until"), F.lit(1).cast("bigint").alias("revision"))
    return q, now


@query("WITH " + _QUEUE + " SELECT id, lane, created_at, CAST(row_number() OVER (PARTITION BY lane ORDER BY created_at, id) AS INTEGER) AS place FROM q, n WHERE status = 'received' AND (lease_until IS NULL OR lease_until <= now)")
def claimable_queue(spark, sf_dir):
    q, now = _queue(spark, sf_dir)
    return messages.claimable_queue(q, now).select("id", "lane", "created_at", "place")


@query("WITH " + _QUEUE + """ SELECT id, lane, 'processing' AS status, 'w1' AS claimed_by, now AS claimed_at, now + INTERVAL 300 SECOND AS lease_until FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY created_at, id) AS place FROM q, n WHERE status = 'received' AND (lease_until IS NULL OR lease_until <= now)) WHERE place = 1""")
def lease_claims(spark, sf_dir):
    """The oldest free event of each type, claimed."""
    q, now = _queue(spark, sf_dir)
    return messages.claims(q, now, "w1").select("id", "lane", "status", "claimed_by", "claimed_at", "lease_until")


@query("WITH " + _QUEUE + " SELECT id, lane, 'received' AS status, revision + 1 AS revision FROM q, n WHERE status = 'processing' AND lease_until <= now")
def expired_leases(spark, sf_dir):
    q, now = _queue(spark, sf_dir)
    return messages.expired_leases(q, now).select("id", "lane", "status", "revision")


def text_map(**pairs: str):
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _envelopes(spark, sf_dir) -> DataFrame:
    """Conversations as message envelopes, some spoilt by fixed rules on the id."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn")
    ident = uuid5(uuid.NAMESPACE_URL, n.cast("string"))
    parts = {
        "schema_version": F.when(n % 11 == 0, F.lit(2)).otherwise(F.lit(1)), "id": F.when(n % 13 == 0, F.lit("no-uuid")).otherwise(ident), "created_at": F.when(n % 17 == 0, F.lit("2024-02-30T00:00:00Z")).otherwise(F.lit("2024-02-29T00:00:00Z")),
        "sender": F.when(n % 19 == 0, F.lit("stranger")).otherwise(F.lit("operator")), "recipient": F.lit("worker"), "type": F.lit("task"), "subject": F.when(n % 23 == 0, F.lit("")).otherwise(F.col("role")), "body": F.col("text"),
        "correlation_id": F.lit(None).cast("string"), "artifacts": F.array_compact(F.array(F.when(F.col("turn") % 2 == 0, text_map(kind="doc", name="n", url="https://h/y")), F.when(F.col("turn") % 3 == 0, text_map(name="a", uri="file:///x", sha256="0" * 64)))), "metadata": F.struct(F.col("conv_id").alias("conv")),
    }
    kept = [(k, v) for k, v in parts.items()]
    return c.select("conv_id", "turn", F.to_json(F.struct(*[v.alias(k) for k, v in kept]), {"ignoreNullFields": "false"}).alias("json"))


_N = "(conv_id * 100 + turn)"


@query(rf"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN {_N} % 11 = 0 THEN 'schema_version' END, CASE WHEN {_N} % 13 = 0 THEN 'id' END, CASE WHEN {_N} % 17 = 0 THEN 'created_at' END, CASE WHEN {_N} % 19 = 0 THEN 'sender' END, CASE WHEN {_N} % 23 = 0 THEN 'subject' END], lambda x: x IS NOT NULL), ',') AS codes FROM conversations""")
def envelope_validation(spark, sf_dir):
    return messages.validate_envelopes(_envelopes(spark, sf_dir), "json", ["operator", "worker"]).select("conv_id", "turn", "codes")


@query("""SELECT event_id, sha256(replace(replace(replace(props, ': ', ':'), ', ', ','), chr(10), '')) AS hash FROM events""")
def canonical_hashes(spark, sf_dir):
    """Canonical form of event properties, equal for reordered keys."""
    return table(spark, sf_dir, "events").select("event_id", F.sha2(canonical_json(F.col("props")), 256).alias("hash"))


@query(r"""SELECT event_id, NOT event_id % 3 = 0 AS is_uuid, NOT event_id % 4 = 0 AS is_time FROM events""")
def identifier_checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ident = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.upper(uuid5(uuid.NAMESPACE_DNS, F.col("event_id").cast("string"))))
    time = F.when(F.col("event_id") % 8 == 0, F.lit("2023-02-29T10:00:00Z")).when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", is_canonical_uuid(ident).alias("is_uuid"), is_utc_z(time).alias("is_time"))


@query("SELECT event_id, i AS position, 'n' || CAST(i AS VARCHAR) AS name, CASE WHEN i = 0 THEN 'file:///x' ELSE 'https://h/y' END AS uri FROM (SELECT event_id, CAST(unnest(generate_series(0, event_id % 3 - 1)) AS INTEGER) AS i FROM events)")
def explode_artifacts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    all_ = F.array(*[F.struct(F.lit(f"n{i}").alias("name"), (F.lit("file:///x") if i == 0 else F.lit(None)).cast("string").alias("uri"), (F.lit(None) if i == 0 else F.lit("https://h/y")).cast("string").alias("url"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("kind")) for i in range(2)])
    rows = e.select("event_id", F.slice(all_, F.lit(1), (F.col("event_id") % 3).cast("int")).alias("artifacts"))
    return messages.explode_artifacts(rows, ["event_id"]).select("event_id", "position", "name", "uri")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'lane' WHEN event_id % 4 = 2 THEN 'domain,key,lane' ELSE 'approval' END AS route_codes FROM events""")
def routed_validation(spark, sf_dir):
    """Events as routed tasks: right, on a wrong lane, of an unknown domain, and not approved."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 4
    domain = F.format_string("%02d", (F.col("event_id") % 9).cast("int"))
    empty = F.array().cast("array<string>")
    brief = F.struct(F.lit("o").alias("outcome"), *[empty.alias(x) for x in messages.BRIEF[1:]])
    meta = F.struct(
        F.when(n == 2, "99").otherwise(domain).alias("project_domain"), F.concat(F.lit("key-"), domain).alias("cloud_conversation_key"), F.concat(F.lit("lane/"), F.when(n == 1, "99").otherwise(domain)).alias("local_lane"),
        F.lit("lead").alias("authority"), F.when(n == 3, "pending").otherwise("approved_for_local_implementation").alias("approval_state"), F.lit("FAST").alias("change_mode"), brief.alias("implementation_brief"),
    )
    doc = F.struct(F.lit("task").alias("type"), F.lit("planner").alias("sender"), F.lit("worker").alias("recipient"), meta.alias("metadata"))
    routes = spark.createDataFrame([(f"{i:02d}", f"key-{i:02d}", f"lane/{i:02d}") for i in range(9)], "domain string, cloud_conversation_key string, local_lane string")
    return messages.validate_routed(e.select("event_id", F.to_json(doc).alias("json")), "json", routes, "planner", "worker", "lead").select("event_id", "route_codes")


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(['a/' || CAST(turn AS VARCHAR), 'b/' || role])), ',') AS paths FROM conversations WHERE conv_id % 5 <> 0
    UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE conv_id % 5 = 0""")
def normalized_paths(spark, sf_dir):
    """Path lists with repeats, back slashes and trailing slashes; every fifth conversation has a refused one."""
    c = table(spark, sf_dir, "conversations")
    last = F.when(F.col("conv_id") % 5 == 0, F.lit("../up")).otherwise(F.concat(F.lit("b\\"), "role"))
    paths = F.array(F.concat(F.lit(" a/"), F.col("turn").cast("string"), F.lit("/")), F.concat(F.lit("a/"), F.col("turn").cast("string")), last)
    given = c.select("conv_id", "turn", paths.alias("given"))
    refused = F.exists("given", lambda p: normalize_path(p).isNull())
    return given.select("conv_id", "turn", F.when(~refused, normalize_paths(F.col("given"))).alias("paths"))


@query("""WITH t AS (SELECT DISTINCT conv_id, 'task-result:' || CAST(conv_id AS VARCHAR) AS name FROM conversations),
    d AS (SELECT conv_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS h FROM t)
    SELECT conv_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS result_id FROM d""")
def result_ids(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", result_id(F.col("conv_id").cast("string")).alias("result_id"))


@query("WITH " + _QUEUE + """ SELECT id, local_lane, created_at, CAST(row_number() OVER (PARTITION BY local_lane ORDER BY created_at, id) AS INTEGER) AS place FROM (SELECT *, 'lane/' || CAST(id % 9 AS VARCHAR) AS local_lane FROM q), n
    WHERE status = 'received' AND (lease_until IS NULL OR lease_until <= now) AND id % 2 = 0 AND id % 5 <> 0 AND id % 7 <> 0""")
def routed_queue(spark, sf_dir):
    """Events as routed messages: odd ones are answers, every fifth is not approved, every seventh has another authority."""
    q, now = _queue(spark, sf_dir)
    kind = F.when(F.col("id") % 2 == 0, "task").otherwise("response")
    state = F.when(F.col("id") % 5 == 0, "pending").otherwise(messages.APPROVED)
    rows = q.withColumns({"message_type": kind, "approval_state": state, "authority": F.when(F.col("id") % 7 == 0, "other").otherwise("lead"), "local_lane": F.concat(F.lit("lane/"), (F.col("id") % 9).cast("string"))})
    return messages.routed_queue(rows, now, "lead").select("id", "local_lane", "created_at", "place")


_BAD = " OR ".join(f"{_N} % {n} = 0" for n in (11, 13, 17, 19, 23))


@query(rf"""SELECT prefix || CASE WHEN {_BAD} THEN 'invalid' ELSE good END AS outcome, count(*) AS messages FROM conversations, (VALUES ('', 'accepted'), ('repeated: ', 'duplicate'), ('again: ', 'duplicate')) AS t(prefix, good) GROUP BY ALL
    UNION ALL SELECT 'stored', count(*) FROM conversations WHERE NOT ({_BAD})
    UNION ALL SELECT 'artifacts', CAST(sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM conversations WHERE NOT ({_BAD})
    UNION ALL SELECT 'quarantined', 2 * count(*) FROM conversations WHERE {_BAD}""")
def ingest_job(spark, sf_dir):
    """Envelopes as landed files: one batch, the same batch repeated, and the same files as another batch. The repetition
    adds nothing; the other batch logs its own rejects."""
    root = f"{shared_folder(spark)}/barline/ingest-{uuid.uuid4().hex}"
    files = _envelopes(spark, sf_dir).select(F.concat(F.lit("inbox/"), "conv_id", F.lit("-"), "turn", F.lit(".json")).alias("path"), F.encode("json", "UTF-8").alias("content"))
    spark.createDataFrame([], MESSAGES).write.parquet(f"{root}/messages")
    counts = []
    for prefix, batch in (("", "1"), ("repeated: ", "1"), ("again: ", "2")):
        run = ingest_batch(files, f"{root}/messages", f"{root}/quarantine", f"{root}/work", ["operator", "worker"], batch, f"{root}/artifacts").collect()
        counts += [(prefix + r.outcome, r.messages) for r in run]
    counts += [(name, spark.read.parquet(f"{root}/{folder}").count()) for name, folder in (("stored", "messages"), ("artifacts", "artifacts"), ("quarantined", "quarantine"))]
    return spark.createDataFrame(counts, "outcome string, messages long")


@query("""WITH puts AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn, text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) AS place, count(*) FILTER (turn % 2 = 0) OVER (PARTITION BY conv_id) AS evens FROM conversations)
    SELECT id, CAST(CASE WHEN turn % 2 = 0 THEN place ELSE evens + 100 + place - evens END AS INTEGER) AS version, CASE WHEN turn % 2 = 0 THEN 'proposed' ELSE 'accepted' END AS status, sha256(body) AS body FROM puts""")
def decision_versions(spark, sf_dir):
    """Conversations as decisions: even turns are versions in their order; then odd ones, the first of them a
    hundred above the newest and the rest after it."""
    path = f"{shared_folder(spark)}/barline/decisions-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", F.concat(F.lit("t"), "turn").alias("title"), F.sha2("text", 256).alias("body"), F.lit(None).cast("string").alias("source_message_id"))
    none = F.lit(None).cast("int")
    put_decisions(c.filter("turn % 2 = 0").withColumns({"version": none, "status": F.lit("proposed")}), path, "turn")
    evens = c.groupBy("id").agg(F.count_if(F.col("turn") % 2 == 0).alias("evens"), F.min(F.when(F.col("turn") % 2 == 1, F.col("turn"))).alias("first"))
    odd = c.filter("turn % 2 = 1").join(evens, "id").withColumns({"version": F.when(F.col("turn") == F.col("first"), F.col("evens") + 101).cast("int"), "status": F.lit("accepted")})
    put_decisions(odd, path, "turn")
    return spark.read.schema(DECISIONS).parquet(path).select("id", "version", "status", "body")
