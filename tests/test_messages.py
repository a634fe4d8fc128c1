import json

import pytest
import uuid

from pyspark.sql import functions as F

from barline.functions.text import canonical_json, normalize_path, normalize_paths, uri_fault, uuid5
from barline.operators import messages
from barline.sources.envelopes import read_roles, read_routes
from barline.streaming.ingest import ingest_envelopes

ROLES = ["lead", "worker", "planner", "all-chats"]


def envelope(**over):
    base = dict(schema_version=1, id=str(uuid.uuid4()), created_at="2024-02-29T10:00:00Z", sender="planner", recipient="worker", type="task", subject="s", body="b", correlation_id=None, artifacts=[], metadata={})
    return base | over


def codes(spark, *docs):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "n int, json string")
    return [r.codes for r in messages.validate_envelopes(df, "json", ROLES).orderBy("n").collect()]


def test_envelope_rules(spark):
    local = {"name": "a", "uri": "file:///a", "sha256": "0" * 64}
    cases = [
        (envelope(artifacts=[local, {"kind": "pr", "name": "x", "url": "https://h/x"}]), []),
        (envelope() | {"extra": 1}, ["keys"]),
        (envelope(schema_version="1"), ["schema_version"]), (envelope(schema_version=2), ["schema_version"]), (envelope(id="x"), ["id"]),
        (envelope(created_at="2024-02-30T10:00:00Z"), ["created_at"]), (envelope(sender="all-chats"), ["sender"]), (envelope(sender="x"), ["sender"]),
        (envelope(recipient="all-chats"), ["broadcast_type"]), (envelope(recipient="all-chats", type="status"), []), (envelope(type="x"), ["type"]), (envelope(subject=""), ["subject"]),
        (envelope(body="api_key = abc"), ["body_secret"]), (envelope(body="-----BEGIN PRIVATE KEY-----"), ["body_secret"]), (envelope(correlation_id="1"), ["correlation_id"]),
        (envelope(artifacts=[local | {"x": 1}]), ["artifact_shape"]), (envelope(artifacts=[local | {"uri": "ftp://h"}]), ["uri_scheme"]), (envelope(artifacts=[local | {"uri": "https://h/?API-KEY=1"}]), ["uri_parameter"]),
        (envelope(artifacts=[local | {"sha256": "0"}]), ["artifact_detail"]), (envelope(metadata=[1]), ["metadata"]), (envelope(metadata={"a": [{"Seed Phrase": 1}]}), ["metadata_keys"]), (envelope(metadata={"a": "x" * 17_000}), ["metadata_size"]),
        ("{", ["json"]), ('{"id": 1, "id": 2}', ["json"]),
    ]
    got = codes(spark, *[c for c, _ in cases])
    for (case, want), have in zip(cases, got):
        assert set(want) <= set(have) and (want or not have), (case, want, have)
        assert len(have) == len(want) or case == "{" or want == ["metadata"], (case, have)


def routed(**over):
    brief = dict(outcome="o", approved_logic=[], in_scope=[], non_goals=[], acceptance_criteria=["x"], required_tests=[], risks=[], stop_conditions=[])
    meta = dict(project_domain="03", cloud_conversation_key="k-03", local_lane="l/03", authority="lead", approval_state="approved_for_local_implementation", change_mode="FAST", implementation_brief=brief)
    return envelope(metadata=meta | over)


def test_routing(spark, tmp_path):
    channels = [{"domain": f"{i:02d}", "cloud_conversation_key": f"k-{i:02d}", "local_lane": f"l/{i:02d}"} for i in range(9)]
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"schema_version": 1, "channels": channels}, indent=1))
    routes = read_routes(spark, str(path), "k-", "l/")
    result = dict(verification_verdict="ALIGNED", changed_files=[], commands=[{"command": "c", "exit_code": 0, "summary": "s"}], git_state={}, skipped_checks=[], risks=[], next_safe_step="n", permission_state=dict.fromkeys(["commit", "push", "merge", "deployment", "live_enablement"], False))
    back = dict(sender="worker", recipient="planner", type="response")
    bad = result | {"permission_state": result["permission_state"] | {"push": True}}
    docs = [
        (routed(), []), (envelope(), []), (routed(project_domain="77"), ["domain"]), (routed(local_lane="l/04"), ["lane"]), (routed(approval_state="no"), ["approval"]), (routed(change_mode="SLOW"), ["mode"]),
        (routed() | {"sender": "worker", "recipient": "planner"}, ["direction"]), (routed(result=result) | back, []), (routed(result=bad) | back, ["permissions"]), (routed(implementation_brief={}), ["brief"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(docs)], "n int, json string")
    got = [r.route_codes for r in messages.validate_routed(df, "json", routes, "planner", "worker", "lead").orderBy("n").collect()]
    for (doc, want), have in zip(docs, got):
        assert set(want) <= set(have) and bool(want) == bool(have), (want, have)


def test_names(spark):
    row = spark.range(1).select(uuid5(uuid.NAMESPACE_URL, F.lit("résumé-1")).alias("u"), canonical_json(F.lit('{"b": 1, "a": {"d": 2, "c": 3}}')).alias("j"), normalize_paths(F.array(F.lit(" b\\c/ "), F.lit("a"), F.lit("a"))).alias("p"), normalize_path(F.lit("a/../b")).alias("x"), normalize_path(F.lit("/a")).alias("y"), uri_fault(F.lit("git://h/x?a=1")).alias("f")).first()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "résumé-1"))
    assert row.j == '{"a":{"c":3,"d":2},"b":1}' and row.p == ["a", "b/c"] and row.x is None and row.y is None and row.f is None


def test_roles(spark, tmp_path):
    (tmp_path / "roles.md").write_text("# Roles\n| `one` | x |\n|---|---|\n| two | `no` |\n")
    assert {r.role for r in read_roles(spark, str(tmp_path / "roles.md"), ["lead"]).collect()} == {"one", "lead"}


def test_ingest(spark, tmp_path):
    inbox, out = tmp_path / "in", {x: str(tmp_path / x) for x in ("messages", "quarantine", "work", "check")}
    inbox.mkdir()
    first = envelope()
    run = lambda: ingest_envelopes(spark, str(inbox), out["messages"], out["quarantine"], out["work"], ROLES, out["check"]).awaitTermination()
    (inbox / "a.json").write_text(json.dumps(first))
    run()
    (inbox / "b.json").write_text(json.dumps(dict(reversed(first.items()))))
    (inbox / "c.json").write_text(json.dumps(first | {"body": "other"}))
    (inbox / "d.json").write_bytes(b'{"a": "\xff"}')
    run()
    assert spark.read.parquet(out["messages"]).count() == 1
    assert sorted(r.kind for r in spark.read.parquet(out["quarantine"]).collect()) == ["integrity_conflict", "invalid"]


def test_a_batch_takes_effect_once(spark, tmp_path, monkeypatch):
    """A process that dies between the appends, and the batch run again under its id."""
    from barline.streaming import ingest

    out = {x: str(tmp_path / x) for x in ("messages", "quarantine", "work", "artifacts")}
    spark.createDataFrame([], ingest.MESSAGES).write.parquet(out["messages"])
    good = envelope() | {"artifacts": [{"kind": "doc", "name": "n", "url": "https://h/y"}]}
    files = spark.createDataFrame([(f"{n}.json", json.dumps(x).encode()) for n, x in (("a", good), ("b", good | {"body": "other"}), ("c", {}))], "path string, content binary")
    run = lambda batch: {r.outcome: r.messages for r in ingest.ingest_batch(files, out["messages"], out["quarantine"], out["work"], ROLES, batch, out["artifacts"]).collect()}
    count = lambda name: spark.read.parquet(out[name]).count()

    def dies(*_):
        raise KeyboardInterrupt

    for step in ("write_artifacts", "write_quarantine"):
        with monkeypatch.context() as m:
            m.setattr(ingest, step, dies)
            with pytest.raises(KeyboardInterrupt):
                run("7")
        assert count("messages") == 1
    assert run("7") == {"duplicate": 1, "integrity_conflict": 1, "invalid": 1}
    assert [count(x) for x in ("messages", "artifacts", "quarantine")] == [1, 1, 2]
    before = sorted(spark.read.parquet(out["quarantine"]).collect())
    run("7")
    assert sorted(spark.read.parquet(out["quarantine"]).collect()) == before
    run("8")
    assert [count(x) for x in ("messages", "artifacts", "quarantine")] == [1, 1, 4]
    assert ingest.find_message(spark, out["messages"], good["id"].upper()).first().source_uri == "a.json" and ingest.find_message(spark, out["messages"], "x").count() == 0


def test_decisions(spark, tmp_path):
    from barline.sources.tables import get_decision, put_decisions

    path = str(tmp_path / "decisions")
    put = lambda *rows: put_decisions(spark.createDataFrame([(i, v, "t", s, f"body {n}", None, n) for n, (i, v, s) in enumerate(rows)], "id string, version int, title string, status string, body string, source_message_id string, n int"), path, "n")
    put(("a", None, "proposed"), ("a", None, "accepted"), ("b", 4, "proposed"), ("b", None, "rejected"))
    assert [(r.version, r.body) for r in get_decision(spark, path, "a").collect()] == [(2, "body 1")]
    assert get_decision(spark, path, "a", 1).first().status == "proposed" and get_decision(spark, path, "b").first().version == 5
    for rows in ([("a", 2, "proposed")], [("a", None, "open")], [("c", 0, "proposed")], [("c", 3, "proposed"), ("c", 3, "accepted")], [("c", None, "proposed"), ("a", 1, "proposed")]):
        with pytest.raises(ValueError):
            put(*rows)
    assert spark.read.parquet(path).count() == 4 and get_decision(spark, path, "c").count() == 0


def test_versions_and_queue(spark):
    v = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 2)], "id string, n int, version int")
    assert [r.n for r in messages.version_faults(v, "id", "n").collect()] == [3]
    assert messages.latest_version(v.filter("n < 3"), "id").collect()[0].version == 2
    p = spark.createDataFrame([(1, "a/b"), (2, "a"), (3, "a/bc")], "id int, path string")
    assert {(r.left_id, r.right_id) for r in messages.path_overlaps(p, p).collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (3, 2), (2, 3)}
