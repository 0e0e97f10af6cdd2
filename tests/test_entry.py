import os

import duckdb
import pytest

import __spark_entry__ as entry
from assayer import plans
from assayer.plans.tables import TABLES, Given

SMALL = "/root/testdata/sf0.001"
# One or two of each kind; scripts/check_queries.py runs them all.
SAMPLE = [
    "score_summary", "pattern_match", "select_compare", "all_findings", "run_seal", "closure", "source_survey",
    "display_names", "assemble_chunks", "lint_pairs", "prepare_cases", "render_requests", "schedule_position",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def test_every_query_has_its_sql():
    """The removable part's queries are tested with it."""
    assert set(plans.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


# All of them with ASSAYER_ALL=1; some minutes.
if os.environ.get("ASSAYER_ALL"):
    SAMPLE = list(plans.QUERIES)


def test_every_plan_resolves(spark):
    """Names and types of all queries, without running them."""
    for name, build in plans.QUERIES.items():
        assert build(Given.open(spark, SMALL)).columns, name


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    want = duck.execute(entry.oracle_sql()[name])
    named = [d[0] for d in want.description]
    assert sorted(named) == columns
    order = [named.index(c) for c in columns]
    key = lambda row: tuple(repr(plain(v)) for v in row)
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(key, frame.select(*columns).collect())) == sorted(map(key, rows))


def test_the_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
