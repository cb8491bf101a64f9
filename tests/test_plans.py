"""Plans: what is pushed down, pruned, and kept out of Python."""

import os

import pytest

import __spark_entry__ as entry
from tidemill import Engine
from tidemill.plans import rewrite

SF = "/root/testdata/sf0.001"


@pytest.fixture
def engine(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    e = Engine(spark)
    e.register_parquet(SF, "lineitem", "orders", "customer", "nation")
    return e


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filters_and_columns_reach_the_scan(engine):
    p = plan(engine.execute("SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R' GROUP BY l_orderkey"))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in p and "EqualTo(l_returnflag,R)" in p
    assert "l_extendedprice" not in p and "l_shipdate" not in p


def test_filters_pass_an_outer_join_to_the_kept_side(engine):
    p = plan(engine.execute("SELECT c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 9000"))
    assert "GreaterThan(c_acctbal,9000.0)" in p and "o_totalprice" not in p and "c_mktsegment" not in p


def test_aggregation_is_partial_first(engine):
    p = plan(engine.execute("SELECT l_returnflag, HISTOGRAM_NUMERIC(l_quantity, 5) AS h, STDDEV(l_tax) AS s FROM lineitem GROUP BY l_returnflag"))
    assert "partial_count_if" in p or "partial_count(" in p
    assert "collect_list" not in p


def test_top_k_is_one_operator(engine):
    assert "TakeOrderedAndProject" in plan(engine.execute("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"))


def test_partition_folders_are_pruned(spark, tmp_path):
    e = Engine(spark)
    for layout in ("col=value", "value"):
        n = "p" + layout[0]
        e.execute(f"CREATE TABLE {n} (id INT) WITH (path='{tmp_path}/{n}', file_name='a.csv', partition_format='{layout}') PARTITIONED BY (dt); INSERT OVERWRITE {n} VALUES (1, 'd1'), (2, 'd2'), (3, 'd3')")
        df = e.execute(f"SELECT id FROM {n} WHERE dt = 'd2'")
        assert [r.id for r in df.collect()] == [2]
        if layout == "col=value":
            assert "PartitionFilters: [isnotnull(dt" in plan(df)


def test_the_dialect_runs_no_python(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for name, run in entry.queries().items():
        if not name.startswith(("op", "io_", "refused_")) and name != "pipeline":  # stores that Spark doesn't know are read through Python
            p = plan(run(spark, SF))
            assert "Python" not in p and "Arrow" not in p and "InPandas" not in p, name
            assert name in ("join_cross", "not_in_subquery", "exists_subquery", "not_exists_subquery", "histogram_numeric") or "CartesianProduct" not in p, name


def test_not_in_is_no_broadcast_of_the_subquery(spark, engine):
    """Nor of a nested one: both are anti joins over distinct keys, which shuffle where they are large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in ("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)", "SELECT o_orderkey FROM orders WHERE o_custkey < 5 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"):
            assert "Broadcast" not in plan(engine.execute(q)), q
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_percentiles_of_many_values_are_not_gathered(spark, engine, monkeypatch):
    """Equal to Spark's own, from the narrowed-down values alone: the fallback for small groups is cut off in the SQL."""
    monkeypatch.setattr(rewrite, "HEAVY", 20)
    for accuracy in (2000, 20):
        monkeypatch.setattr(rewrite, "ACCURACY", accuracy)
        for x, table, by in (("l_extendedprice", "lineitem", ""), ("l_quantity", "lineitem", "l_returnflag"), ("if(o_custkey % 7 = 0, NULL, o_totalprice)", "orders", "o_orderstatus")):
            ps = ("0", "0.25", "'0.5'", "0.999", "1")
            first, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
            sql = engine.rewritten(f"SELECT {first}{', '.join(f'PERCENTILE_APPROX({x}, {p}) AS p{k}' for k, p in enumerate(ps))} FROM {table}{group}")
            assert " IS NULL, cast(" in sql
            want = spark.sql(f"SELECT {first}{', '.join(f'percentile({x}, cast({p} as double)) AS p{k}' for k, p in enumerate(ps))} FROM {table}{group}")
            assert sorted(spark.sql(sql.replace(" IS NULL, cast(", " IS NULL AND false, cast(")).collect()) == sorted(want.collect())
    assert "CartesianProduct" not in plan(engine.execute("SELECT PERCENTILE_APPROX(l_extendedprice, 0.5) AS m FROM lineitem"))
