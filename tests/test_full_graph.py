"""Queries on a small table made by hand: hubs, repeated parts of an order, a quantity that is missing."""

import duckdb
import pytest

from knotwork.queries import ORACLES, QUERIES

from .test_oracles import rows


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Orders of up to four parts around a hub, nearly all in small quantities; one quantity is missing."""
    at = tmp_path_factory.mktemp("full")
    duckdb.sql(
        "COPY (SELECT g AS l_orderkey, CAST(CASE WHEN i = 0 AND g % 3 = 0 THEN 1 ELSE 2 + (g * 7 + i * i * 5) % 23 END AS BIGINT) AS l_partkey, CASE WHEN g = 5 THEN NULL ELSE 1 + (g + i) % 45 END::DOUBLE AS l_quantity"
        f" FROM range(40) a(g), range(4) b(i)) TO '{at}/lineitem.parquet'"
    )
    return str(at)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"part_labels"}))
def test_query_on_all_rows_equals_its_sql(spark, small, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS FROM '{small}/lineitem.parquet'")
    want = db.sql(ORACLES[name])
    df = QUERIES[name](spark, small)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1e-9) if any(isinstance(x, float) for x in g) else g == w


def test_no_query_leaves_rows_out():
    assert not any("l_quantity" in sql for sql in ORACLES.values())
