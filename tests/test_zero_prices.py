"""The queries of the jobs on events of which some have the value 0: their bars break the rule of positive prices."""

import os

import duckdb
import pytest

from barline.plans.catalog import QUERIES, SQL

from .oracle import TABLES, rows_of, sql_rows

DATA = "/root/testdata/sf0.001"
#: Events whose value is 0 here: of clicks, purchases and signups after the first day, or of views in the first hours too.
LATE = "event_id % 40 = 3 AND event_type IN ('purchase', 'signup') AND ts > TIMESTAMP '2024-01-03'"
EARLY = f"({LATE}) OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-01 12:00:00')"


@pytest.fixture(scope="session")
def made(tmp_path_factory):
    out = {}
    for name, zero in (("late", LATE), ("early", EARLY)):
        folder = tmp_path_factory.mktemp(name)
        for t in TABLES:
            if t != "events":
                os.symlink(f"{DATA}/{t}.parquet", folder / f"{t}.parquet")
        duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN {zero} THEN 0 ELSE value END AS value) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
        out[name] = str(folder)
    return out


def same(spark, name, folder):
    got = rows_of(QUERIES[name](spark, folder))
    assert got == sql_rows(folder, SQL[name])
    return got[1]


@pytest.mark.parametrize("name", ["export_job", "full_build"])
def test_exports(spark, made, name):
    assert same(spark, name, made["late"])


def test_fallbacks_with_broken_bars(spark, made):
    rows = same(spark, "complete_fallbacks", made["late"])
    assert {r[0] for r in rows if r[3].startswith("d-signup")} == {True, False}


def test_reconciled_with_broken_bars(spark, made):
    assert same(spark, "reconciled_fallbacks", made["late"])


def test_repair_with_broken_bars(spark, made):
    assert same(spark, "repair_job", made["late"])


@pytest.mark.parametrize("name", ["import_job", "import_refusals", "import_events", "import_ranges"])
def test_imports_with_broken_bars(spark, made, name):
    rows = same(spark, name, made["late"])
    assert name != "import_refusals" or ("broken rule or repeated key", "signup-1h-2024-01.zip") in rows


def test_import_again_with_broken_bars(spark, made):
    rows = same(spark, "import_again", made["late"])
    assert sorted(r[1:] for r in rows) == [(2, 2), (3, 3), (5, 1)]


@pytest.mark.parametrize("name", ["sync_runs", "sync_stages", "sync_table", "sync_summaries"])
@pytest.mark.parametrize("bad", ["late", "early"])
def test_syncs_with_broken_bars(spark, made, bad, name):
    rows = same(spark, name, made[bad])
    assert bool(rows) == (bad == "late" or name in ("sync_runs", "sync_stages"))
