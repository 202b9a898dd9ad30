"""Every named query against DuckDB on the same tables."""

from collections import Counter

import duckdb
import pytest

from chronoweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(catalogue.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9 and set(e.oracle_sql()) <= set(e.queries())


#: Queries whose result is a row or a few; their last exchange gathers partial sums.
SUMMARIES = {"count_by_msg_type", "stream_intersection", "trim_losses", "trim_empty", "top_k"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_window_over_all_rows(spark, name):
    """No window or sort of any query gathers all rows in one partition."""
    if name in SUMMARIES:
        return
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, x in enumerate(lines):
        if "SinglePartition" in x:
            above = [y.strip(" :+-") for y in lines[max(0, i - 4) : i]]
            assert not any(y.startswith("Window") and "partition" in y.lower() for y in above), (name, above)


def test_hot_second(spark):
    """With nine in ten rows in one second and one time, no range holds most rows, and positions are those of a plain sort."""
    from pyspark.sql import functions as F

    from chronoweave.operators.position import Ordered

    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id") * 10**9).otherwise(5 * 10**12).alias("t"), F.xxhash64("id").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = Ordered(rows, [F.col("t").asc_nulls_first(), F.col("k").asc()], "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ordered.rows.groupBy("_cw_range").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 20_000
    got = {r.id: r.pos for r in ordered.with_position().select("id", "pos").collect()}
    plain = sorted(rows.collect(), key=lambda r: (r.t, r.k))
    assert got == {r.id: i + 1 for i, r in enumerate(plain)}
    before = {r.id: r.b for r in ordered.with_previous("b").select("id", "b").collect()}
    assert before == {r.id: (plain[i - 1].t if i else None) for i, r in enumerate(plain)}


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of a megabyte at most."""
    from chronoweave.operators import position

    monkeypatch.setattr(position, "RANGE_BYTES", 1 << 20, raising=False)


def test_ranges_follow_size(spark, small_ranges):
    """what a task sorts stays the same as a table grows, also where there are more ranges than shuffle partitions."""
    from pyspark.sql import functions as F

    from chronoweave.operators.position import Ordered

    most = {}
    for n in (60_000, 240_000):
        rows = spark.range(n).select((F.col("id") * 7919 % n).alias("t"), F.col("id").alias("k"))
        ordered = Ordered(rows, [F.col("t").asc(), F.col("k").asc()], "t")
        most[n] = max(r["count"] for r in ordered.rows.groupBy("_cw_range").count().collect())
        assert ordered.with_position().where("pos <> t + 1").count() == 0
        previous = ordered.with_previous("b")
        assert previous.where("not (b <=> nullif(t - 1, -1))").count() == 0
    assert most[240_000] < 1.5 * most[60_000] and most[240_000] * 64 < 2 << 20
    assert previous.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = previous._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # the window takes the rows as they were dealt out


def test_ranges_follow_width(spark, small_ranges):
    """long texts, also within structs and arrays, make more ranges of the same number of rows."""
    from pyspark.sql import functions as F

    from chronoweave.operators.position import Ordered

    rows = spark.range(2_000)
    key = [F.col("id").asc()]
    ranges = lambda df: Ordered(df, key).rows.select("_cw_range").distinct().count()
    n = [ranges(rows.withColumn("a.b", c)) for c in (F.lit(1), F.repeat(F.lit("x"), 5_000), F.struct(F.repeat(F.lit("x"), 5_000).alias("s")), F.array(F.repeat(F.lit("x"), 5_000)), F.lit(None).cast("binary"))]
    assert n[0] == n[4] == 1 and min(n[1:4]) >= 9
    assert Ordered(rows.limit(0), key).with_position().count() == 0


def test_merge_sorts_only_given_columns(spark, monkeypatch):
    """columns that the merged rows lack are not moved and sorted; the result has them all the same."""
    from chronoweave.operators import mux, position
    from chronoweave.schema import COLUMNS

    sorted_columns = []
    monkeypatch.setattr(position, "stored", lambda df, tag, stored=position.stored: sorted_columns.append(df.columns) or stored(df, tag))
    rows = spark.createDataFrame([(1, 2, "EV", 7), (1, 1, "SB", 5)], "port_ord int, src_seq long, msg_type string, ts_ns long")
    out = mux.mux(rows, timed=True)
    assert out.columns == [*COLUMNS, "pos"] and [r["msg_type"] for r in out.orderBy("pos").collect()] == ["SB", "EV"]
    assert len(sorted_columns) == 1 and len(sorted_columns[0]) < 12


@pytest.mark.parametrize("name", ["mux_order", "mux_ties"])
def test_mux_queries_sort_narrow_rows(spark, monkeypatch, name):
    """the queries hand no columns to the merge that are null in every row of theirs but those of the stream's identity."""
    from chronoweave.operators import position

    sorted_columns = []
    monkeypatch.setattr(position, "stored", lambda df, tag, stored=position.stored: sorted_columns.append(df.columns) or stored(df, tag))
    catalogue.queries()[name](spark, SF)
    assert len(sorted_columns) == 1 and len(sorted_columns[0]) < 12
