"""Line items that share order and line number: queries keep the first in the order of files and rows, as SQL read in order."""

import random

import pandas as pd
import pytest

import __spark_entry__ as entry
from foliospark import queries

#: Queries over one row for each order and line number.
NAMES = "decomposed_totals extractive_answers installment_column label_value_facts markdown_router schedule_rows typical_value amount_terms extreme_rows period_change schedule_records".split()


def rows(seed: int, n: int) -> pd.DataFrame:
    r = random.Random(seed)
    keys = [(k, r.randint(1, 3 + k % 5)) for k in r.choices(range(1, 61), k=n)]
    made = [(*key, r.randint(1, 90), float(r.choice([1, 1, 1, 2, 3])), r.randint(100_00, 999_99) / 100, r.choice("ANR"), r.randint(0, 900)) for key in keys]
    out = pd.DataFrame(made, columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"])
    out["l_shipdate"] = (pd.Timestamp("2020-01-01") + pd.to_timedelta(out["l_shipdate"], "D")).astype("datetime64[us]")
    return out.astype({"l_linenumber": "int32"})


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A smaller file before a larger one of the same keys: Spark reads the larger one first."""
    at = tmp_path_factory.mktemp("tables")
    (at / "lineitem.parquet").mkdir()
    rows(1, 300).to_parquet(at / "lineitem.parquet" / "a.parquet", index=False)
    rows(2, 3000).to_parquet(at / "lineitem.parquet" / "b.parquet", index=False)
    pd.DataFrame({"o_orderkey": range(1, 61), "o_custkey": [k % 20 for k in range(1, 61)]}).to_parquet(at / "orders.parquet", index=False)
    return str(at)


@pytest.mark.parametrize("split", [False, True])
def test_first_line_stays(spark, tables, tmp_path, split):
    """In two files, and in one of several row groups that are read by tasks of their own."""
    every = pd.concat([rows(1, 300), rows(2, 3000)])
    if split:
        every.to_parquet(tmp_path / "lineitem.parquet", index=False, row_group_size=400)
        tables = str(tmp_path)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = queries.lines(spark, tables).select(*every.columns).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    key = ["l_orderkey", "l_linenumber"]
    want = every.drop_duplicates(key).sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want, check_dtype=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_keeps_first_line(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tables}/lineitem.parquet/*.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tables}/orders.parquet'")
    got, want = entry.queries()[name](spark, tables).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    plain = lambda df: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert len(want) > 0 and plain(got) == plain(want)
