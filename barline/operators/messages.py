"""Message envelopes: validation, routing, de-duplication, versions and queues."""

from __future__ import annotations

import json as jsonlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import utc_date
from ..functions.text import FORBIDDEN_KEYS, has_secret, is_canonical_uuid, is_utc_z, lease_expired, lease_until, length_between, list_ok, normalize_key, uri_fault

#: The fields of an envelope, of its artifacts, and the closed value sets.
FIELDS = ["schema_version", "id", "created_at", "sender", "recipient", "type", "subject", "body", "correlation_id", "artifacts", "metadata"]
LOCAL_ARTIFACT, EXTERNAL_ARTIFACT = ["name", "sha256", "uri"], ["kind", "name", "url"]
TYPES = ["task", "response", "decision", "status", "error"]
ROUTING = ["project_domain", "cloud_conversation_key", "local_lane", "authority", "approval_state"]
BRIEF = ["outcome", "approved_logic", "in_scope", "non_goals", "acceptance_criteria", "required_tests", "risks", "stop_conditions"]
RESULT = ["verification_verdict", "changed_files", "commands", "git_state", "skipped_checks", "risks", "next_safe_step", "permission_state"]
PERMISSIONS = ["commit", "push", "merge", "deployment", "live_enablement"]
MODES, VERDICTS = ["FAST", "STANDARD", "STRICT"], ["ALIGNED", "CONDITIONAL", "BLOCKED"]
BROADCAST_ROLE = "all-chats"
MOST_ARTIFACTS, MOST_METADATA_BYTES = 100, 16_384
APPROVED = "approved_for_local_implementation"


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def exact_keys(json: Column, names: list[str]) -> Column:
    """struct(missing, extra) of a JSON object's keys against `names`."""
    want, have = F.array(*[F.lit(n) for n in names]), _keys(json)
    return F.struct(F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("extra"))


def _same_keys(json: Column, names: list[str]) -> Column:
    x = exact_keys(json, names)
    return F.coalesce((F.size(x["missing"]) == 0) & (F.size(x["extra"]) == 0), F.lit(False))


def _codes(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()]))


def _get(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _kind(json: str, path: str, kind: str, parsed: Column | None = None) -> Column:
    """Whether the JSON value at a path has a type: 'string', 'int', 'object', 'array', 'bool', 'null'."""
    pattern = {"string": "^STRING$", "int": "^BIGINT$", "object": "^OBJECT", "array": "^ARRAY", "strings": "^ARRAY<(STRING|VOID)>$", "bool": "^BOOLEAN$", "null": "^VOID$"}[kind]
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(json)) if parsed is None else parsed, path, "variant")).rlike(pattern)


def _key_paths(text: str) -> Iterator[tuple[str, str]]:
    """(path, name) of every object key of a JSON text, at any depth."""
    stack = [("$", jsonlib.loads(text))]
    while stack:
        path, value = stack.pop()
        inside = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for name, x in inside:
            at = f"{path}.{name}" if isinstance(value, dict) else f"{path}[{name}]"
            if isinstance(value, dict):
                yield at, name
            stack.append((at, x))


def forbidden_keys(df: DataFrame, json: str, key: list[str]) -> DataFrame:
    """(key columns, path) of every object key, at any depth, whose normalised form is forbidden. Only
    texts that hold such a name at all are walked; invalid JSON has no keys."""
    held = df.filter(has_forbidden_key(F.col(json))).select(*key, F.col(json).alias("__json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, path, name) for i, text in enumerate(batch.column(len(key)).to_pylist()) for path, name in _key_paths(text)]
            rows, paths, names = zip(*found) if found else ((), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([*[batch.column(c).take(at) for c in range(len(key))], pa.array(paths, pa.string()), pa.array(names, pa.string())], names=[*key, "path", "__name"])

    fields = [f for f in held.schema.fields if f.name in key]
    schema = T.StructType([*fields, T.StructField("path", T.StringType()), T.StructField("__name", T.StringType())])
    return held.mapInArrow(run, schema).filter(normalize_key(F.col("__name")).isin(*FORBIDDEN_KEYS)).drop("__name")


def has_forbidden_key(json: Column) -> Column:
    """Whether any key of the JSON text, at any depth, normalises to a forbidden name. Looks at every
    quoted name before a colon of the canonical text. Letters and digits are never escaped there, so an
    escaped character counts as any other that is none: as `_`."""
    plain = F.regexp_replace(F.to_json(F.try_parse_json(json)), r"\\(?:u[0-9A-Fa-f]{4}|.)", "_")
    names = F.regexp_extract_all(plain, F.lit(r'"([^"]*+)"\s*:'), F.lit(1))
    return F.coalesce(F.exists(names, lambda n: normalize_key(n).isin(*FORBIDDEN_KEYS)), F.lit(False))


def artifact_codes(artifacts: Column) -> Column:
    """Codes of the broken artifact rules of an envelope; `artifacts` is an array of JSON texts."""

    def one(x: Column) -> Column:
        keys = F.array_sort(_keys(x))
        shape = (keys == F.array(*[F.lit(k) for k in LOCAL_ARTIFACT])) | (keys == F.array(*[F.lit(k) for k in EXTERNAL_ARTIFACT]))
        uri = F.coalesce(_get(x, "$.uri"), _get(x, "$.url"))
        detail = F.when(_get(x, "$.uri").isNotNull(), F.coalesce(_get(x, "$.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).otherwise(length_between(_get(x, "$.kind"), 1, 80))
        return F.when(~shape, "artifact_shape").when(~length_between(_get(x, "$.name"), 1, 255) | ~length_between(uri, 1, 2048), "artifact_text").otherwise(F.coalesce(uri_fault(uri), F.when(~detail, "artifact_detail")))

    return F.array_distinct(F.array_compact(F.transform(artifacts, one)))


def envelope_codes(json: str, roles: list[str]) -> Column:
    """Codes of every broken v1 rule of a JSON envelope."""
    j = F.col(json)
    text = {f: _get(j, f"$.{f}") for f in FIELDS}
    artifacts = F.from_json(text["artifacts"], "array<string>")
    rules = {
        "keys": _same_keys(j, FIELDS),
        "schema_version": _kind(json, "$.schema_version", "int") & (text["schema_version"] == "1"),
        "id": is_canonical_uuid(text["id"]),
        "created_at": is_utc_z(text["created_at"]),
        "sender": text["sender"].isin(*roles) & (text["sender"] != BROADCAST_ROLE),
        "recipient": text["recipient"].isin(*roles),
        "type": text["type"].isin(*TYPES),
        "broadcast_type": (text["recipient"] != BROADCAST_ROLE) | ~text["type"].isin("task", "response", "error"),
        "subject": _kind(json, "$.subject", "string") & length_between(text["subject"], 1, 240),
        "body": _kind(json, "$.body", "string") & length_between(text["body"], 0, 100_000),
        "body_secret": ~has_secret(text["body"]),
        "correlation_id": is_canonical_uuid(text["correlation_id"], nullable=True),
        "artifacts": _kind(json, "$.artifacts", "array") & (F.size(artifacts) <= MOST_ARTIFACTS),
        "metadata": _kind(json, "$.metadata", "object"),
        "metadata_keys": ~has_forbidden_key(text["metadata"]),
        "metadata_size": F.octet_length(F.to_json(F.try_parse_json(text["metadata"]))) <= MOST_METADATA_BYTES,
    }
    return F.when(F.try_parse_json(j).isNull(), F.array(F.lit("json"))).otherwise(F.concat(_codes(rules), F.coalesce(artifact_codes(artifacts), F.array().cast("array<string>"))))


def validate_envelopes(df: DataFrame, json: str, roles: list[str]) -> DataFrame:
    """The rows with `codes`, empty for valid envelopes. Duplicate keys make JSON invalid."""
    return df.withColumn("codes", envelope_codes(json, roles))


def routed_codes(json: str, sender: str, receiver: str, authority: str) -> Column:
    """Codes of the broken routing rules of an envelope beside its route (columns route_key and
    route_lane, null where its domain is unknown) and its parts (__parsed, __metadata, __brief, __result), which
    are read once a row. Envelopes without routing fields pass."""
    m, parsed = F.col("__metadata"), F.col("__parsed")
    kind, approval = _get(F.col(json), "$.type"), _get(m, "$.approval_state")
    names = F.array(*[F.lit(x) for x in ROUTING])
    present = F.array_intersect(_keys(m), names)
    is_from = (_get(F.col(json), "$.sender") == sender) & (_get(F.col(json), "$.recipient") == receiver)
    is_to = (_get(F.col(json), "$.sender") == receiver) & (_get(F.col(json), "$.recipient") == sender)
    brief, result = F.col("__brief"), F.col("__result")
    parts = {"brief": brief, "result": result}
    at = {"brief": "$.metadata.implementation_brief", "result": "$.metadata.result"}
    strings = lambda of, name: _kind(json, f"{at[of]}.{name}", "strings", parsed) & list_ok(F.from_json(_get(parts[of], f"$.{name}"), "array<string>"))
    commands = F.from_json(_get(result, "$.commands"), "array<string>")
    command_ok = F.forall(commands, lambda c: (F.array_sort(_keys(c)) == F.array(F.lit("command"), F.lit("exit_code"), F.lit("summary"))) & length_between(_get(c, "$.command"), 1, 4096) & length_between(_get(c, "$.summary"), 1, 4096) & F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), "$.exit_code", "variant")).rlike("^BIGINT$"))
    permissions = F.from_json(_get(result, "$.permission_state"), "map<string,boolean>")
    task, answer = kind == "task", kind.isin("response", "status", "error")
    rules = {
        "fields": F.size(present) == len(ROUTING),
        "domain": F.col("route_key").isNotNull(),
        "key": _get(m, "$.cloud_conversation_key") == F.col("route_key"),
        "lane": _get(m, "$.local_lane") == F.col("route_lane"),
        "authority": _get(m, "$.authority") == authority,
        "type": task | answer,
        "direction": (~task | is_from) & (~answer | is_to),
        "approval": ~task | (approval == APPROVED),
        "mode": ~task | _get(m, "$.change_mode").isin(*MODES),
        "brief": ~task | (_same_keys(brief, BRIEF) & length_between(_get(brief, "$.outcome"), 1, 4096) & _all(strings("brief", x) for x in BRIEF[1:])),
        "result": ~answer | (_same_keys(result, RESULT) & _get(result, "$.verification_verdict").isin(*VERDICTS) & _all(strings("result", x) for x in ("changed_files", "skipped_checks", "risks")) & _kind(json, "$.metadata.result.git_state", "object", parsed) & length_between(_get(result, "$.next_safe_step"), 1, 4096)),
        "commands": ~answer | ((F.size(commands) <= 200) & command_ok),
        "permissions": ~answer | (_same_keys(_get(result, "$.permission_state"), PERMISSIONS) & F.forall(F.map_values(permissions), lambda v: ~v)),
    }
    return F.when(F.size(present) == 0, F.array().cast("array<string>")).otherwise(_codes(rules))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def route_lookup(df: DataFrame, routes: DataFrame, domain: str) -> DataFrame:
    """Add route_key and route_lane. The route map has nine rows, so it is broadcast."""
    small = routes.select(F.col("domain").alias("__d"), F.col("cloud_conversation_key").alias("route_key"), F.col("local_lane").alias("route_lane"))
    return df.join(F.broadcast(small), F.col(domain) == F.col("__d"), "left").drop("__d")


def validate_routed(df: DataFrame, json: str, routes: DataFrame, sender: str, receiver: str, authority: str) -> DataFrame:
    tagged = route_lookup(df.withColumn("__domain", _get(F.col(json), "$.metadata.project_domain")), routes, "__domain")
    held = tagged.withColumns({"__parsed": F.try_parse_json(F.col(json)), "__metadata": _get(F.col(json), "$.metadata")})
    held = held.withColumns({"__brief": _get(F.col("__metadata"), "$.implementation_brief"), "__result": _get(F.col("__metadata"), "$.result")})
    return held.withColumn("route_codes", routed_codes(json, sender, receiver, authority)).drop("__domain", "route_key", "route_lane", "__parsed", "__metadata", "__brief", "__result")


def classify_messages(incoming: DataFrame, existing: DataFrame, order: str = "arrival") -> DataFrame:
    """`outcome` of each incoming row (id, canonical_hash, order): accepted, duplicate or
    integrity_conflict, against the stored messages and the earlier rows of the batch. The first
    row of an id is found by aggregation, so a hot id does not gather in one task."""
    stored = existing.groupBy("id").agg(F.min("canonical_hash").alias("stored_hash"))
    first = incoming.groupBy("id").agg(F.min_by("canonical_hash", F.struct(order, "canonical_hash")).alias("first_hash"), F.min(F.struct(order, "canonical_hash"))[order].alias("first_at"))
    known = first.join(stored, "id", "left").select("id", F.coalesce("stored_hash", "first_hash").alias("true_hash"), "first_at", F.col("stored_hash").isNull().alias("unseen"))
    outcome = F.when(F.col("unseen") & (F.col(order) == F.col("first_at")), "accepted").when(F.col("canonical_hash") == F.col("true_hash"), "duplicate").otherwise("integrity_conflict")
    return incoming.join(known, "id").withColumn("outcome", outcome).drop("true_hash", "first_at", "unseen")


def ingest_outcomes(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count("*").alias("messages"))


def correlate_results(tasks: DataFrame, results: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """Each task with the number of its results, whether it has more than one, and whether the
    fields of `same` agree. A result belongs to coalesce(correlation_id, id)."""
    r = results.select(F.coalesce("correlation_id", "id").alias("id"), F.col("id").alias("result_id"), *[F.col(c).alias(f"r_{c}") for c in same])
    agree = _all(F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in same)
    joined = tasks.join(r, "id", "left").groupBy("id").agg(F.count("result_id").alias("results"), F.min("result_id").alias("first_result"), F.count_if(F.col("result_id").isNotNull() & ~agree).alias("mismatches"))
    return joined.withColumn("conflict", F.col("results") > 1)


def explode_artifacts(df: DataFrame, key: list[str], artifacts: str = "artifacts") -> DataFrame:
    """One row per artifact: position, name, uri (or url), sha256 and media_type."""
    rows = df.select(*key, F.posexplode_outer(artifacts).alias("position", "a"))
    return rows.filter("a IS NOT NULL").select(*key, "position", "a.name", F.coalesce("a.uri", "a.url").alias("uri"), "a.sha256", F.col("a.kind").alias("media_type"))


def latest_version(df: DataFrame, id: str, version: str = "version") -> DataFrame:
    """The newest version of each id."""
    rest = [c for c in df.columns if c != id]
    top = df.groupBy(id).agg(F.max_by(F.struct(*rest), version).alias("x"))
    return top.select(id, "x.*")


def as_version(df: DataFrame, version_of: Column, version: str = "version") -> DataFrame:
    return df.filter(F.col(version) == version_of)


def version_faults(df: DataFrame, id: str, order: str, version: str = "version") -> DataFrame:
    """Rows whose version does not exceed every earlier one of its id."""
    before = Window.partitionBy(id).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("highest_before", F.max(version).over(before)).filter((F.col(version) <= F.col("highest_before")) | (F.col(version) < 1))


def newest(df: DataFrame, order: str, id: str, n: int = 25) -> DataFrame:
    """The n newest rows; equal times by id."""
    return df.orderBy(F.desc(order), F.desc(id)).limit(n)


def claimable_queue(messages: DataFrame, now: Column, lane: str = "lane", authority: str | None = None) -> DataFrame:
    """Inbound received messages whose lease is free, oldest first within their lane. Places are
    numbered inside the UTC days of a lane, each after the days before it, so that no lane is one task."""
    free = messages.filter((F.col("direction") == "inbound") & (F.col("status") == "received") & lease_expired(F.col("lease_until"), now))
    if authority is not None:
        free = free.filter(~F.col("recipient").eqNullSafe(F.lit(authority)))
    free = free.withColumn("__day", utc_date(F.col("created_at")))
    upto = Window.partitionBy("__lane").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = free.groupBy(F.col(lane).alias("__lane"), F.col("__day").alias("__of")).agg(F.count("*").alias("__n")).withColumnRenamed("__of", "__day")
    starts = days.select(F.col("__lane"), F.col("__day").alias("__of"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))  # one row to a day
    placed = free.join(starts, F.col(lane).eqNullSafe(F.col("__lane")) & F.col("__day").eqNullSafe(F.col("__of")))
    inside = F.row_number().over(Window.partitionBy(lane, "__day").orderBy("created_at", "id"))
    return placed.withColumn("place", (F.col("__before") + inside).cast("int")).drop("__day", "__lane", "__of", "__before")


def routed_queue(messages: DataFrame, now: Column, authority: str) -> DataFrame:
    """The routed view of the queue: approved tasks of the authority, by their local lane."""
    tasks = messages.filter((F.col("message_type") == "task") & (F.col("authority") == authority) & (F.col("approval_state") == APPROVED))
    return claimable_queue(tasks, now, "local_lane")


def claims(messages: DataFrame, now: Column, worker: str, seconds: int = 300, lane: str = "lane") -> DataFrame:
    """New state rows for the oldest claimable message of each lane: in work with `worker`, leased from now for
    so many seconds. Equal times go by id; one lane's messages meet as partial minima, not as rows."""
    if not worker or seconds < 1:
        raise ValueError("a claim needs a worker and at least one second")
    free = messages.filter((F.col("direction") == "inbound") & (F.col("status") == "received") & lease_expired(F.col("lease_until"), now))
    rest = F.struct("created_at", "id", *[c for c in free.columns if c not in ("created_at", "id", lane)])
    first = free.groupBy(lane).agg(F.min_by(rest, F.struct("created_at", "id")).alias("x")).select(lane, "x.*").select(*messages.columns)
    return first.withColumns({"status": F.lit("processing"), "claimed_by": F.lit(worker), "claimed_at": now, "lease_until": lease_until(now, F.lit(seconds))})


def expired_leases(messages: DataFrame, now: Column) -> DataFrame:
    """New state rows for messages whose lease has run out: received again, one revision on."""
    out = messages.filter((F.col("status") == "processing") & (F.col("lease_until") <= now))
    return out.withColumns({"status": F.lit("received"), "revision": F.col("revision") + 1, "lease_until": F.lit(None).cast(T.TimestampType())})


def path_overlaps(left: DataFrame, right: DataFrame, key: str = "id", path: str = "path") -> DataFrame:
    """(left key, left path, right key, right path) where the paths are equal or one holds the
    other. Each path is unfolded to its ancestors, so both joins are on equality."""
    a, b = (df.select(F.col(key).alias(f"{s}_{key}"), F.col(path).alias(f"{s}_{path}")).distinct() for df, s in ((left, "left"), (right, "right")))
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), 1, n), "/"))
    inside = a.withColumn("p", F.explode(up(F.col(f"left_{path}")))).join(b, F.col("p") == F.col(f"right_{path}")).drop("p")
    above = b.withColumn("p", F.explode(up(F.col(f"right_{path}")))).join(a, F.col("p") == F.col(f"left_{path}")).filter(F.col(f"left_{path}") != F.col(f"right_{path}")).drop("p")
    return inside.unionByName(above)
