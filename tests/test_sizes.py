"""Queries whose intermediate rows must stay in proportion to their input."""

import duckdb
import pytest

from tests.compare import same
from tidewrack.plans import registry

QUERIES, SQL = registry()


def most_rows(spark, df):
    """Rows that the step with the most of them gave while ``df`` was collected."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert store.executionsCount() == before + 1
    last = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    found = [0]
    for k in range(nodes.size()):
        metrics = nodes.apply(k).metrics()
        for m in (metrics.apply(i) for i in range(metrics.size())):
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Many parts and lines of few names, with nulls and names in both cases; names of one brand, of several and of all."""
    folder = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    con.execute("""CREATE TABLE part AS SELECT i AS p_partkey, CASE WHEN i % 97 = 0 THEN NULL WHEN i % 5 = 0 THEN 'NAME ' || i // 2 % 40 ELSE 'name ' || i // 2 % 40 END AS p_name,
        'Brand#' || CASE WHEN i // 2 % 40 < 30 THEN i // 80 % 3 ELSE i // 2 % 40 END AS p_brand, CAST(1 + i // 80 % 2 AS INT) AS p_size FROM range(4000) r(i)""")
    con.execute("CREATE TABLE lineitem AS SELECT CASE WHEN i % 89 <> 0 THEN i // 3 END AS l_orderkey, CASE WHEN i % 83 <> 0 THEN i * 7919 % 4100 END AS l_partkey FROM range(8000) r(i)")
    for name in ("part", "lineitem"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), con


def test_alias_members_are_counted_once_for_a_group(spark, crowded):
    folder, con = crowded
    same(QUERIES["j5_alias_members"](spark, folder), con, SQL["j5_alias_members"])
    assert most_rows(spark, QUERIES["j5_alias_members"](spark, folder)) <= 3 * 8000


def test_groups_meet_by_distinct_members(spark, crowded):
    folder, con = crowded
    for name in ("j13_set_overlap", "j13b_inherited"):
        same(QUERIES[name](spark, folder), con, SQL[name])
    assert most_rows(spark, QUERIES["j13b_inherited"](spark, folder)) <= 3 * 4000
