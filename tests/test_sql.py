"""Queries against their SQL on frames that stand exactly at the stop threshold."""

import duckdb
import pytest

from kinetra import catalogue


@pytest.fixture(scope="module")
def edge_dir(tmp_path_factory):
    """Events of 24 tracks over 29 days; every third has a frame whose speed by SQL is exactly the threshold of 1.0 and by hypot is below it."""
    d = tmp_path_factory.mktemp("edge")
    duckdb.sql(
        f"""COPY (SELECT u * 10 + n AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (70 * n + u) AS ts, u AS user_id, 'click' AS event_type,
          CASE WHEN u % 3 = 0 AND n % 4 = 2 THEN 2.8 ELSE 20.0 + (u * 37 + n * 53) % 400 END AS value,
          '{{"k": ' || CASE WHEN u % 3 = 0 AND n % 4 = 2 THEN 48 ELSE (u * 7 + n * 29) % 100 END || '}}' AS props
        FROM range(24) a(u), range(11) b(n)) TO '{d}/events.parquet'"""
    )
    return str(d)


@pytest.mark.parametrize("name", ["frame_kinematics", "trajectory_features", "model_features", "robust_scaled", "standard_scaled"])
def test_rows_are_those_of_the_sql(spark, edge_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{edge_dir}/events.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r)) for r in catalogue.queries()[name](spark, edge_dir).select(*names).collect())
    assert len(want) > 0 and got == want
