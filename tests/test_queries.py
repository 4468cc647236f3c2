"""Every core query with SQL agrees with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from rippletrace import artifact_queries, queries  # noqa: F401  (registers its own beside them)

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(None if v is None or v != v else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    ours, theirs = queries.REGISTERED[name](spark, str(DATA)).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_steps_are_executable_and_streams_close_touched_pairs(spark, tmp_path):
    from rippletrace.streaming import change_log as S

    spark.createDataFrame([("p", "X", "a", 1, None), ("q", "X", "z", 2, None)], "pair_id string, change_type string, element_id string, event_seq long, ts timestamp").write.parquet(str(tmp_path / "log"))
    edges = spark.createDataFrame([("p", "a", "b"), ("q", "c", "d")], "pair_id string, src string, dst string")
    seen = []
    q = S.on_touched(S.read_log(spark, str(tmp_path / "log")), edges, lambda df, n: seen.extend((r["pair_id"], r["node"]) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [("p", "a"), ("p", "b"), ("q", "z")]
    assert S.counts_by_window(S.read_log(spark, str(tmp_path / "log"))).isStreaming
