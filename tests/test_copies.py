"""Searches over texts that are mostly copies: equal to SQL, and the pairs compared follow the different texts."""

import random

import pandas as pd
import pytest

import __spark_entry__ as entry


def parts(seed: int, n: int) -> pd.DataFrame:
    """Names shared by many parts, some null, empty or without letters; a twentieth of the keys stands twice or more, one key is null."""
    r = random.Random(seed)
    names = [f"{a} {b}" for a in ("large", "hot", "blue", "é") for b in ("ring", "bolt", "anvil")] + ["", "--", "x", None]
    keys = [*range(n), *r.choices(range(n), k=n // 20), *[5] * 3, None]
    return pd.DataFrame({"p_partkey": pd.array(keys, dtype="Int64"), "p_name": [r.choice(names) for _ in keys]})


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("parts")
    parts(7, 700).to_parquet(at / "part.parquet", index=False, row_group_size=200)
    return str(at)


def test_topk_gram_of_copies(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tables}/part.parquet'")
    got, want = entry.queries()["topk_gram"](spark, tables).toPandas(), con.sql(entry.oracle_sql()["topk_gram"]).df()
    plain = lambda df: sorted(tuple(f"{float(v):.6f}" for v in r) for r in df[["query_id", "p_partkey", "score", "rank"]].fillna(-1).itertuples(index=False))
    assert len(want) > 200 and plain(got) == plain(want)


def test_topk_gram_shuffles_no_pair(spark, tmp_path):
    """9 names, 10,000 parts, 500 queries: a shuffle writes some rows for each part, never for each query and part."""
    names = [f"{a} {b}" for a in ("large", "hot", "blue") for b in ("ring", "bolt", "anvil")]
    pd.DataFrame({"p_partkey": range(10_000), "p_name": [names[k % 9] for k in range(10_000)]}).to_parquet(tmp_path / "part.parquet", index=False)
    made = entry.queries()["topk_gram"](spark, str(tmp_path))
    assert len(made.collect()) == 5_000
    counts, todo = [], [made._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        written = node.metrics().get("shuffleRecordsWritten")
        if written.isDefined():
            counts.append(written.get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert 0 < max(counts) < 25_000
