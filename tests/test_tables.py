import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.sources.tables import PartialTable, folder_path
from pulsewatch.streaming import live

T0 = dt.datetime(2024, 1, 1)


def counts_table(spark, path, **options):
    merge = lambda p: p.groupBy("k").agg(F.sum("n").alias("n"))
    return PartialTable(spark, str(path), "k string, n long", merge, **options)


def fill(spark, table, batches):
    for b in batches:
        table.write(spark.createDataFrame([("a", 1), ("b", b)], "k string, n long"), b)
        table.keep(b, every=2)


def test_a_reader_outlives_two_cleans(spark, tmp_path):
    table = counts_table(spark, tmp_path)
    fill(spark, table, range(3))
    early = table.read()
    fill(spark, table, range(3, 9))
    assert rows(early) == [("a", 3), ("b", 3)], "its files are still there"
    assert rows(table.read()) == [("a", 9), ("b", 36)]


def test_leases_run_out(spark, tmp_path):
    table = counts_table(spark, tmp_path, lease=0.001)
    fill(spark, table, range(8))
    left = [f.name for f in (tmp_path / "delta").iterdir() if f.is_dir()]
    assert len(left) <= 4 and rows(table.read()) == [("a", 8), ("b", 28)]
    table.clean()
    assert len(table._numbers("upto")) == 2


def test_a_batch_goes_on_from_the_ones_before(spark, tmp_path):
    table = counts_table(spark, tmp_path)
    fill(spark, table, range(3))
    assert rows(table.read(before=2)) == [("a", 2), ("b", 1)]
    assert table.holds(0) and table.holds(2) and not table.holds(3)


def test_a_divided_view_opens_only_its_hours(spark, tmp_path):
    view = live.rollup_table(spark, f"{tmp_path}/view", keys=("k",), layout="1 hour")
    schema = "window_start timestamp, window_end timestamp, k string, cnt long, mean double, m2 double, min double, max double"
    for b in range(4):
        data = [(T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1), "x", 1, float(h), 0.0, float(h), float(h)) for h in range(b, b + 6)]
        view.write(spark.createDataFrame(data, schema), b)
        view.keep(b, every=2)
    some = view.read(between=("2024-01-01 02:00:00", "2024-01-01 04:00:00"))
    assert rows(some, "cnt", "mean") == [(3, 2.0), (4, 3.0), (4, 4.0)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_stretch" in plan
    assert view.read().count() == 9
    root, fs = folder_path(spark, f"{tmp_path}/view/base/upto=3")
    assert sum(1 for s in fs.listStatus(root) if s.getPath().getName().startswith("_stretch=")) == 9


def test_an_empty_divided_view(spark, tmp_path):
    view = live.rollup_table(spark, f"{tmp_path}/view", keys=("k",), layout="1 hour")
    assert view.read(between=("2024-01-01", "2024-01-02")).collect() == []
