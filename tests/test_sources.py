from datetime import date, datetime

import pytest

from freshet.sources import checks, log_source, results, schemas, tables, text_log


def log_text(head, days, foot=12, tail="\n"):
    line = lambda d: f"  {d}   1.0  1550.5  {100 + d}  1 2 0.1   {10 * d} 0.0  0.5 "
    return "\n".join(["head"] * head + [line(d) for d in days] + ["foot"] * foot) + tail


def test_text_logs_by_year_and_layout(spark, tmp_path):
    (tmp_path / "LAKE_JAN_2017.txt").write_text(log_text(10, [1, 2, 3]))
    (tmp_path / "LAKE_FEB_2018.txt").write_text(log_text(11, [1, 2], tail="\n\n"))
    broken = log_text(11, [1, 2, 3]).replace("  2   1.0  1550.5", "  2   1550.5")
    (tmp_path / "LAKE_MAR_2019.txt").write_text(broken)
    (tmp_path / "notes.txt").write_text("not a log")
    df = text_log.read_text_logs(spark, str(tmp_path))
    got = sorted((r.year, r.month, r.day, r.inflow_adj, r.storage_2400) for r in df.collect())
    assert got == [
        (2017, 1, 1, 10.0, 101.0), (2017, 1, 2, 20.0, 102.0), (2017, 1, 3, 30.0, 103.0),
        (2018, 2, 1, 10.0, 101.0), (2018, 2, 2, 20.0, 102.0),
        (2019, 3, 1, 10.0, 101.0), (2019, 3, 3, 30.0, 103.0),  # the short line is dropped
    ]
    some = text_log.read_text_logs(spark, str(tmp_path), 2018, 2018)
    assert {r.year for r in some.collect()} == {2018}
    assert df.columns == ["station", "year", "month", *[n for _, n in schemas.LOG_FIELDS]]


def test_file_shorter_than_its_frame_has_no_rows(spark, tmp_path):
    (tmp_path / "LAKE_JAN_2017.txt").write_text("a\nb\n")
    assert text_log.read_text_logs(spark, str(tmp_path)).count() == 0


def test_daily_log_from_csv(spark, tmp_path):
    path = tmp_path / "all.csv"
    path.write_text(
        ",day,storage (2400hr),inflow adj,rainfall inches (7A to Dam),rainfall inches (7A to BSN),month,year\n"
        "0,2,5,30,0.1,,JAN,2020\n1,1,4,abc,0.2,0.3,1,2020\n2,30,4,1,0,0,FEB,2020\n"
    )
    rows = sorted(tables.daily_log(tables.read_csv(spark, str(path))).collect(), key=lambda r: r.date_day)
    assert [(r.date_day, r.inflow_adj, r.rain_bsn_in, r.storage_2400) for r in rows] == [
        (date(2020, 1, 1), None, 0.3, 4.0), (date(2020, 1, 2), 30.0, None, 5.0),
    ]


def test_missing_columns_are_named(frame):
    df = frame([(1,)], "year int")
    with pytest.raises(ValueError, match="inflow_adj.*rain_bsn_in"):
        tables.daily_log(df)
    with pytest.raises(ValueError, match="volumetric_soil_water_layer_1"):
        tables.soil_hours(frame([("x",)], "time string"))
    with pytest.raises(ValueError, match="area_m2_used"):
        tables.subbasin_rows(frame([("x", 1.0)], "date string, rain_mm_aw double"), "rain_mm_aw", "rain")


def test_soil_and_subbasin_rows(frame):
    soil = frame([("2024-01-01 05:00:00", "0.25"), ("2024-01-01 06:00:00", "")], "time string, volumetric_soil_water_layer_1 string")
    assert [(r.time, r.soil) for r in tables.soil_hours(soil).collect()] == [
        (datetime(2024, 1, 1, 5), 0.25), (datetime(2024, 1, 1, 6), None),
    ]
    rain = frame([("2024-01-01", "10.5", "3"), ("bad", "10.5", "3"), ("2024-01-02", "", "1")],
                 "date string, area_m2_used string, rain_mm_aw string")
    got = tables.subbasin_rows(rain, "rain_mm_aw", "rain").collect()
    assert [(r.date_day, r.area, r.rain) for r in got] == [(date(2024, 1, 1), 10.5, 3.0)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_results_round_trip(spark, frame, tmp_path, fmt):
    df = frame([(1, 2020, 0.5), (2, 2021, None)], "id int, year int, x double")
    path = str(tmp_path / fmt)
    results.write_result(df, path, fmt, ["year"] if fmt == "parquet" else None)
    back = spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
    assert sorted(back.select("id", "year", "x").collect()) == sorted(df.collect())


def test_feature_choice_warns_and_fails(frame):
    df = frame([(1, 2)], "a int, b int")
    with pytest.warns(UserWarning, match="zz"):
        assert checks.pick_features(df, ["b", "zz", "a"]) == ["b", "a"]
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no feature"):
        checks.pick_features(df, ["zz"])


def test_literal_table_difference_and_correlation(spark):
    from pyspark.sql import functions as F

    from freshet.operators.windows import SeriesWindow

    rows = [(1, 5, 2, 8, 3), (2, 4, 2, 6, 1), (3, 3, 5, 4, 4), (4, 2, 1, 2, 1), (5, 1, 9, 0, 5)]
    df = tables.literal_table(spark, rows, schemas.SMALL_TABLE).withColumn("series_id", F.lit("t"))
    w = SeriesWindow(order=["A"])
    assert [r.d for r in df.select(w.difference("B").alias("d")).collect()] == [None, -1, -1, -1, -1]
    assert df.agg(F.corr("A", "B")).first()[0] == pytest.approx(-1)


def test_ingest_writes_one_pruned_table(spark, tmp_path):
    from freshet.plans import ingest

    logs, out = tmp_path / "logs", str(tmp_path / "table")
    logs.mkdir()
    for station in ("LAKE", "POND"):
        (logs / f"{station}_JAN_2017.txt").write_text(log_text(10, [1, 2]))
        (logs / f"{station}_FEB_2018.txt").write_text(log_text(11, [3]).replace("0.5 ", "0.5"))
    ingest.combine_text_logs(spark, str(logs), out)
    log = ingest.read_combined(spark, out)
    assert sorted((r.series_id, r.date_day) for r in log.collect()) == [
        (s, d) for s in ("LAKE", "POND") for d in (date(2017, 1, 1), date(2017, 1, 2), date(2018, 2, 3))
    ]
    late = ingest.read_combined(spark, out, first_year=2018, series_id="all")
    assert {r.series_id for r in late.collect()} == {"all"} and late.count() == 2
    assert "PartitionFilters: [isnotnull(year" in late._jdf.queryExecution().toString()


def test_log_source_reads_chosen_files_only(spark, tmp_path):
    (tmp_path / "LAKE_JAN_2017.txt").write_text(log_text(10, [1, 2, 3]))
    (tmp_path / "POND_FEB_2018.txt").write_text(log_text(11, [1, 2], tail="\r\n\n"))
    (tmp_path / "LAKE_MAR_2019.txt").write_text(log_text(11, [1, 2, 3]).replace("  2   1.0  1550.5", "  2   x  1550.5"))
    (tmp_path / "LAKE_APR_2019.txt").write_text("a\nb\n")
    (tmp_path / "notes.txt").write_text("not a log")
    (tmp_path / "year=2018").mkdir()
    (tmp_path / "year=2018" / "LAKE_MAY_2018.txt").write_text(log_text(11, [9]))
    df = log_source.read_logs(spark, str(tmp_path))
    days = lambda d: sorted((r.station, r.year, r.month, r.day, r.inflow_adj) for r in d.collect())
    everything = days(df)
    assert everything == [
        ("LAKE", 2017, 1, 1, 10.0), ("LAKE", 2017, 1, 2, 20.0), ("LAKE", 2017, 1, 3, 30.0), ("LAKE", 2018, 5, 9, 90.0),
        ("LAKE", 2019, 3, 1, 10.0), ("LAKE", 2019, 3, 3, 30.0), ("POND", 2018, 2, 1, 10.0), ("POND", 2018, 2, 2, 20.0),
    ]
    by_spark = text_log.read_text_logs(spark, str(tmp_path / "*.txt"))  # folders of years would be partitions here
    flat = [d for d in everything if d[:3] != ("LAKE", 2018, 5)]
    assert sorted((r.station, r.year, r.month, r.day, r.inflow_adj) for r in by_spark.collect()) == flat
    assert df.rdd.getNumPartitions() == 5
    for options, files, keep in (
        ({"first_year": 2018, "last_year": 2018}, 2, lambda d: d[1] == 2018),
        ({"first_year": 2018, "months": [2, 3]}, 2, lambda d: d[1] > 2017 and d[2] in (2, 3)),
        ({"last_year": 2017}, 1, lambda d: d[1] == 2017),
        ({"stations": ["POND", "SEA"]}, 1, lambda d: d[0] == "POND"),
        ({"first_year": 2030}, 1, lambda d: False),
    ):
        some = log_source.read_logs(spark, str(tmp_path), **options)
        assert days(some) == [d for d in everything if keep(d)], options
        assert some.rdd.getNumPartitions() == files, options
        assert days(some.where("day = 2 OR year = 2017")) == [d for d in everything if keep(d) and (d[3] == 2 or d[1] == 2017)]
    one, other = df.where("year = 2017"), df.where("year = 2018")  # filters of one query do not reach another
    assert days(one.unionByName(other)) == [d for d in everything if d[1] < 2019] and days(df) == everything
    together = log_source.read_logs(spark, str(tmp_path), 2018, 2018, files_per_partition=10)
    assert days(together) == [d for d in everything if d[1] == 2018] and together.rdd.getNumPartitions() == 1


def test_folders_of_years_are_pruned_by_spark(spark, frame, tmp_path):
    columns = ", ".join(f"{m} double" for m in schemas.MEASURES)
    rows = [("LAKE", y, m, 1, *[1.5] * len(schemas.MEASURES)) for y in range(2015, 2021) for m in (1, 2)]
    log_source.write_logs(frame(rows, f"station string, year int, month int, day int, {columns}"), str(tmp_path / "x"), "by_year")
    some = text_log.read_text_logs(spark, str(tmp_path / "x"), first_year=2019)
    assert sorted((r.year, r.month, r.pool) for r in some.collect()) == [(y, m, 1.5) for y in (2019, 2020) for m in (1, 2)]
    assert "PartitionFilters: [isnotnull(year" in some._jdf.queryExecution().toString()
    assert len(some.inputFiles()) == 12 and len(text_log.read_text_logs(spark, str(tmp_path / "x"), 2019, 2020).inputFiles()) == 4


@pytest.mark.parametrize("layout", ["flat", "by_year"])
def test_logs_round_trip_and_are_replaced(spark, frame, tmp_path, layout):
    columns = ", ".join(f"{m} double" for m in schemas.MEASURES)
    schema = f"station string, year int, month int, day int, {columns}"
    measures = [0.1, 1e-7, 123456789.25, -0.0, 5.0, 6.5, 7.0, 8.0, 1e300]
    rows = [("LAKE", y, m, d, *measures) for y in (2016, 2018) for m in (1, 12) for d in range(1, 29)]
    path = str(tmp_path / "logs")
    log_source.write_logs(frame(rows, schema).repartition(5), path, layout)
    assert sorted(map(tuple, log_source.read_logs(spark, path).collect())) == sorted(rows)
    assert len(list(tmp_path.glob("logs/year=*/*.txt"))) == (4 if layout == "by_year" else 0)
    more = [("POND", 2018, 2, 3, *measures)]
    log_source.write_logs(frame(more, schema), path, layout, mode="append")
    assert sorted(map(tuple, log_source.read_logs(spark, path).collect())) == sorted(rows + more)
    gaps = frame([("LAKE", 2018, 1, 1, None), ("LAKE", 2018, 1, 2, 3.0)], "station string, year int, month int, day int, pool double")
    log_source.write_logs(gaps, path, layout)
    assert log_source.read_logs(spark, path).collect() == []  # lines with an empty field are no whole lines
    assert [p.name for p in tmp_path.glob("logs/**/*.txt")] == ["LAKE_JAN_2018.txt"]


def test_a_failed_log_write_changes_nothing(spark, frame, tmp_path):
    from pyspark.sql import functions as F

    columns = ", ".join(f"{m} double" for m in schemas.MEASURES)
    rows = [("LAKE", 2018, m, 1, *[1.0] * len(schemas.MEASURES)) for m in range(1, 13)]
    good = frame(rows, f"station string, year int, month int, day int, {columns}")
    path = str(tmp_path / "logs")
    log_source.write_logs(good, path)
    bad = good.withColumn("pool", F.when(F.col("month") == 7, F.raise_error(F.lit("stop")).cast("double")).otherwise(2.0))
    with pytest.raises(Exception, match="stop"):
        log_source.write_logs(bad, path)
    assert {r.pool for r in log_source.read_logs(spark, path).collect()} == {1.0}
    assert [p for p in tmp_path.glob("logs/**/*") if "staged" in str(p)] == []


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_results_survive_failures_at_every_step(spark, frame, tmp_path, fmt, monkeypatch):
    from pyspark.sql import functions as F

    schema = "id int, day date, x double"
    path = str(tmp_path / "out" / "result")
    read = lambda: sorted((r.id, r.x) for r in results.read_result(spark, path, schema, fmt).collect())
    table = lambda n: frame([(i, date(2020, 1, 1 + i), n / 3) for i in range(5)], schema).repartition(3)
    results.write_result(table(1), path, fmt)
    first = [(i, 1 / 3) for i in range(5)]
    assert read() == first
    stop = F.when(F.col("id") == 3, F.raise_error(F.lit("stop")).cast("double")).otherwise(2.0)
    with pytest.raises(Exception, match="stop"):
        results.write_result(table(1).withColumn("x", stop), path, fmt)
    assert read() == first
    # the former result is read while the new one is written
    results.write_result(results.read_result(spark, path, schema, fmt).withColumn("x", F.col("x") * 6), path, fmt)
    assert read() == [(i, 2.0) for i in range(5)]

    def interrupted(step):
        """Break off before the journal, or at one of the steps that follow it."""
        folder = results.ResultFolder(spark, path)
        staged = folder.staged()
        table(step).write.format(fmt).option("header", True).save(staged)
        if step > 3:
            folder.commit(staged)
        if step > 4:
            folder.fs.delete(folder.path, True)
        if step > 5:
            folder.fs.rename(folder.path_of(staged), folder.path)

    want = [(i, 2.0) for i in range(5)]
    for step in (3, 4, 5, 6):
        interrupted(step)
        want = want if step == 3 else [(i, step / 3) for i in range(5)]
        assert read() == want, step
    monkeypatch.setattr(results.ResultFolder, "commit", lambda self, staged: (_ for _ in ()).throw(OSError("no journal")))
    with pytest.raises(OSError, match="no journal"):
        results.write_result(table(9), path, fmt)
    assert read() == want


def test_csv_cells_are_coerced(spark, tmp_path):
    path = tmp_path / "r"
    path.mkdir()
    (path / "a.csv").write_text("y,day,at,n,extra\n0.5,2020-02-30,2020-01-01 05:06:07,x,1\nnan,2020-02-28,bad,7,2\n,,,,\n")
    got = results.read_result(spark, str(path), "day date, at timestamp_ntz, n long, y double", "csv").collect()
    assert [tuple(r) for r in got] == [
        (None, datetime(2020, 1, 1, 5, 6, 7), None, 0.5), (date(2020, 2, 28), None, 7, None), (None, None, None, None),
    ]
    with pytest.raises(ValueError, match="missing columns \\['z'\\]"):
        results.read_result(spark, str(path), "z int", "csv")
