"""Files of every shape that exports come in, and what is written back."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heliospark.functions.timegrid import from_epoch, wall_seconds
from heliospark.operators import clean, views
from heliospark.plans import pipeline
from heliospark.session import new_folder
from heliospark.sources import readers, writers
from heliospark.streaming import ingest
from tests.conftest import plan
from tests.planted import pv_weather


def put(folder, name, content, mtime=None):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    if mtime is not None:
        os.utime(path, (mtime, mtime))
    return str(path)


def document(series, **scalars):
    return {"nominalPower": 5000, "eToday": "12.5", "eTotal": 340.25, "invPacData": series, **scalars}


MAP = {"2024-01-01 10:00": "1.5", "2024-01-01 10:05": 2.5, "2024-01-01 10:10": "bad"}
PAIRS = [{"time": "2024-01-02 10:00", "pac": "3.5"}, {"time": "2024-01-02 10:05", "pac": 4.5}]


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "generation"
    put(folder, "a.json", document(MAP))
    put(folder, "b.json", document(PAIRS))
    put(folder, "empty.json", document({}))
    put(folder, "null.json", document(None))
    put(folder, "broken.json", "{bad")
    return str(folder)


def test_both_shapes_of_the_series(spark, exports):
    rows = readers.with_scalars(readers.good_rows(readers.read_generation(spark, exports)))
    got = sorted((r["time"], r["pac"]) for r in rows.collect())[:2]
    assert got == [("2024-01-01 10:00", 1.5), ("2024-01-01 10:05", 2.5)]
    assert rows.count() == 5
    assert {(r["nominalPower"], r["eToday"], r["eTotal"]) for r in rows.collect()} == {(5000.0, 12.5, 340.25)}
    assert rows.where(F.col("pac").isNull()).count() == 1


def test_empty_series_can_be_kept(spark, exports):
    good = readers.good_rows(readers.read_generation(spark, exports))
    assert readers.explode_series(good, keep_empty=True).count() == 7


def test_broken_documents_are_told_apart(spark, exports):
    raw = readers.read_generation(spark, exports)
    assert raw.count() == 5
    broken = readers.corrupt_rows(raw).collect()
    assert [r["_corrupt"] for r in broken] == ["{bad"]
    assert broken[0]["_path"].endswith("broken.json")


def test_latest_file_wins(spark, tmp_path):
    folder = tmp_path / "twice"
    put(folder, "z_old.json", document(MAP), mtime=1_700_000_000)
    put(folder, "a_new.json", document({"2024-01-01 10:00": "9.0"}), mtime=1_700_000_900)
    rows = pipeline.generation_rows(readers.read_generation(spark, str(folder)))
    got = {r["ts"]: r["power (kW)"] for r in rows.collect()}
    assert got[dt.datetime(2024, 1, 1, 10, 0)] == 9.0
    assert got[dt.datetime(2024, 1, 1, 10, 5)] == 2.5
    assert len(got) == 3


def test_same_file_time_falls_back_on_path(spark, tmp_path):
    folder = tmp_path / "tie"
    for name, value in (("a.json", "1"), ("b.json", "2")):
        put(folder, name, document({"2024-01-01 10:00": value}), mtime=1_700_000_000)
    rows = pipeline.generation_rows(readers.read_generation(spark, str(folder))).collect()
    assert [r["power (kW)"] for r in rows] == [2.0]


def test_plants_named_by_folder(spark, tmp_path):
    put(tmp_path / "g" / "plant_id=A", "x.json", document(MAP))
    put(tmp_path / "g" / "plant_id=7", "y.json", document(MAP))
    raw = readers.read_generation(spark, str(tmp_path / "g"))
    assert {r["plant_id"] for r in raw.collect()} == {"A", "7"}


def test_times_with_offset_need_a_zone(spark):
    df = spark.createDataFrame([("2024-07-01T12:00:00Z",)], "t string")
    with pytest.raises(PySparkException):
        clean.parse_time(df, "t").collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The second and third fall into New York's repeated and skipped hours.
        texts = ["2024-07-01T12:00:00Z", "2024-11-03T06:30:00Z", "2024-03-10 02:30:00"]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        parsed = clean.parse_time(df, "t", "Europe/Madrid").withColumn("s", wall_seconds("ts"))
        rows = parsed.withColumn("back", from_epoch(F.col("s"))).orderBy("i").collect()
        want = [dt.datetime(2024, 7, 1, 14), dt.datetime(2024, 11, 3, 7, 30), dt.datetime(2024, 3, 10, 2, 30)]
        assert [r["ts"] for r in rows] == [r["back"] for r in rows] == want
        assert [r["s"] for r in rows] == [int((w - dt.datetime(1970, 1, 1)).total_seconds()) for w in want]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times(spark):
    texts = [
        "2024-07-01T12:00:00Z",
        "2024-07-01T12:00:00.0000000Z",
        "2024-07-01T14:00:00+02:00",
        "2024-07-01 12:00",
        "2024-07-01",
        "nonsense",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = clean.parse_time(df, "t", "America/New_York").orderBy("i").collect()
    eight = dt.datetime(2024, 7, 1, 8)
    assert [r["ts"] for r in rows[:3]] == [eight, eight, eight]
    assert rows[3]["ts"] == dt.datetime(2024, 7, 1, 12)
    assert rows[4]["ts"] == dt.datetime(2024, 7, 1)
    assert rows[5]["ts"] is None and rows[6]["ts"] is None


WEATHER_DOC = {
    "air_temp": "20.5", "relative_humidity": 40, "ghi": 500, "dni": 300, "gti": 550,
    "wind_speed_10m": 3, "wind_direction_10m": 350,
}


def observations(*rows):
    return [{"period_end": end, **WEATHER_DOC, **more} for end, more in rows]


def test_build_dataset_from_files(spark, exports, tmp_path):
    put(
        tmp_path / "weather",
        "w.json",
        observations(
            ("2024-01-01T10:05:00Z", {"wind_direction_10m": 350}),
            ("2024-01-01T10:04:00Z", {"wind_direction_10m": 10}),
            ("2024-01-01T10:10:00Z", {"ghi": "n/a"}),
            (None, {}),
            ("2024-01-02T10:05:00Z", {}),
        ),
    )
    out = str(tmp_path / "dataset")
    df = pipeline.build_dataset(spark, exports, str(tmp_path / "weather"), out, site_tz="UTC")
    rows = {r["slot"]: r for r in df.collect()}
    ten = dt.datetime(2024, 1, 1, 10)
    assert set(rows) == {ten, ten + dt.timedelta(minutes=5), dt.datetime(2024, 1, 2, 10)}
    first = rows[ten]
    # The interval that ends at 10:05 is the slot that starts at 10:00.
    assert first["power (kW)"] == 1.5 and first["air_temp"] == 20.5 and first["ghi"] == 500
    assert rows[ten + dt.timedelta(minutes=5)]["ghi"] is None
    assert first["wind_direction_10m"] == 350.0
    assert first["hora"] == 10 and first["fecha"] == dt.date(2024, 1, 1)


def test_left_join_keeps_generation(spark, exports, tmp_path):
    put(tmp_path / "weather", "w.json", observations(("2024-01-01T10:05:00Z", {})))
    df = pipeline.build_dataset(
        spark, exports, str(tmp_path / "weather"), str(tmp_path / "d"), site_tz="UTC", how="left"
    )
    assert df.count() == 5
    assert df.where(F.col("air_temp").isNotNull()).count() == 1


def test_stored_days_are_pruned(spark):
    path = new_folder(spark, "dataset")
    writers.write_dataset(pv_weather(spark, days=10), path)
    stored = readers.load_dataset(spark, path)
    narrow = views.filter_dates(stored, "2023-01-03", "2023-01-04")
    text = plan(narrow.select("slot", "ghi"))
    filters = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert "fecha" in filters and "2023-01-03" in filters
    schema = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "ghi" in schema and "dni" not in schema
    assert narrow.count() == 48
    hours = views.filter_hours(stored, 8, 9)
    assert "GreaterThanOrEqual(hora,8)" in plan(hours)
    # The trailing views are bounded by a subquery on the day partitions too.
    last = plan(views.recent(stored, 2))
    assert any("fecha" in x and "Subquery" in x for x in last.splitlines() if "PartitionFilters" in x)
    assert views.recent(stored, 2).count() == 48


def test_dataset_round_trip(spark):
    path = new_folder(spark, "dataset")
    df = pv_weather(spark, days=3, plants=2)
    writers.write_dataset(df, path)
    back = readers.load_dataset(spark, path).select(df.columns)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def test_csv_round_trip(spark, tmp_path):
    df = pv_weather(spark, days=2).select("plant_id", "slot", "ghi").orderBy("slot")
    path = str(tmp_path / "csv")
    writers.export_csv(df, path)
    back = (
        spark.read.schema(df.schema)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    assert back.exceptAll(df).isEmpty() and back.count() == 48


def test_results_accumulate(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "model string, rmse double")
    path = str(tmp_path / "results")
    writers.write_metrics(df, path)
    writers.write_metrics(df, path)
    assert spark.read.parquet(path).count() == 2


def test_continuous_reading(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    put(folder, "a.json", document(MAP), mtime=1_700_000_000)

    def run():
        rows = ingest.stream_generation(spark, str(folder))
        ingest.append_rows(rows, out, checkpoint, once=True).awaitTermination(120)
        return {r["ts"].minute: r["pac"] for r in ingest.latest_rows(spark, out).collect()}

    assert run() == {0: 1.5, 5: 2.5, 10: None}
    put(folder, "b.json", document({"2024-01-01 10:00": "7.0"}), mtime=1_700_000_500)
    assert run() == {0: 7.0, 5: 2.5, 10: None}
    assert run() == {0: 7.0, 5: 2.5, 10: None}
    assert spark.read.parquet(out).count() == 4


def test_continuous_weather(spark, tmp_path):
    put(tmp_path / "in", "w.json", observations(("2024-01-01T10:05:00Z", {}), (None, {})))
    rows = ingest.stream_weather(spark, str(tmp_path / "in"), site_tz="UTC")
    ingest.append_rows(rows, str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination(120)
    got = ingest.latest_rows(spark, str(tmp_path / "o")).collect()
    assert [(r["ts"], r["air_temp"]) for r in got] == [(dt.datetime(2024, 1, 1, 10, 5), 20.5)]


def test_no_machine_local_folder_on_a_cluster():
    from heliospark import session

    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        session.shared_root(Fake())


def test_a_repeated_hour_keeps_both_its_readings(spark, tmp_path):
    """New York, autumn: 05:30Z and 06:30Z are both 01:30; spring leaves a gap and loses none."""
    ends = ("2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "2024-11-03T06:30:00+00:00", "2024-03-10T06:30:00Z", "2024-03-10T07:30:00Z")
    put(tmp_path / "w", "w.json", observations(*[(end, {"ghi": 100 * i}) for i, end in enumerate(ends)]))
    rows = pipeline.weather_rows(readers.read_weather(spark, str(tmp_path / "w")), "America/New_York").collect()
    assert sorted((r["ts"].month, r["ts"].hour) for r in rows) == [(3, 1), (3, 3), (11, 1), (11, 1)]


def test_batch_and_stream_agree_on_a_repeated_hour(spark, tmp_path):
    """An autumn change, with a later file that corrects one of the two readings of 01:30."""
    first = observations(*[(f"2024-11-03T0{h}:30:00Z", {"ghi": 100 * h}) for h in (4, 5, 6, 7)])
    put(tmp_path / "w", "a.json", first, mtime=1_700_000_000)
    put(tmp_path / "w", "b.json", observations(("2024-11-03T06:30:00Z", {"ghi": 1})), mtime=1_700_000_500)
    zone = "America/New_York"
    batch = pipeline.weather_rows(readers.read_weather(spark, str(tmp_path / "w")), zone)
    rows = ingest.stream_weather(spark, str(tmp_path / "w"), zone, max_files=1)
    ingest.append_rows(rows, str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination(120)
    told = [sorted((r["ts"], r["ghi"]) for r in df.collect()) for df in (batch, ingest.latest_rows(spark, str(tmp_path / "o")))]
    assert told[0] == told[1] and [g for t, g in told[0] if (t.hour, t.minute) == (1, 30)] == [1.0, 500.0]


def test_quality_is_stored_beside_the_dataset(spark, tmp_path):
    generation, weather, out = (tmp_path / n for n in ("g", "w", "d"))
    generation.mkdir()
    weather.mkdir()
    good = '{"nominalPower": "5", "eToday": "1", "eTotal": "2", "invPacData": {"2024-01-01 10:00": 3.5, "2024-01-01 10:05": null}}'
    (generation / "a.json").write_text(good)
    (generation / "b.json").write_text('{"nominalPower": "5", "invPacData": 17}')
    (generation / "c.json").write_text("{bad")
    rows = [{"period_end": f"2024-01-01T10:{m:02d}:00Z", "ghi": g} for m, g in ((5, 2000.0), (10, 3.0))]
    (weather / "w.json").write_text("\n".join(map(json.dumps, rows)))
    (weather / "x.json").write_text("{bad")
    spark_args = dict(site_tz="UTC", multi_line=False, as_of=dt.datetime(2024, 1, 1, 10, 2))
    (generation / "a.json").write_text(good)
    pipeline.build_dataset(spark, str(generation), str(weather), str(out), **spark_args)
    found = {(r["source"], r["variable"], r["check"]): r["n"] for r in spark.read.parquet(pipeline.quality_path(str(out))).collect()}
    assert found["generation", None, "documents"] == 3 and found["generation", None, "corrupt"] == 1
    assert found["generation", None, "series unreadable"] == 1
    assert found["weather", None, "documents"] == 3 and found["weather", None, "corrupt"] == 1
    assert found["dataset", "ghi", "outside"] == 1 and found["dataset", "air_temp", "missing"] == found["dataset", "ghi", "rows"] == 2
    assert found["dataset", "slot", "future"] == 1


def test_a_new_day_rewrites_that_day_only(spark, tmp_path):
    path = str(tmp_path / "days")
    df = pv_weather(spark, days=4)
    writers.write_dataset(df.where(F.dayofmonth("slot") < 5), path, hemisphere="south")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    writers.write_dataset(df.where(F.dayofmonth("slot") == 5), path, touched_days_only=True, hemisphere="south")
    stored = readers.load_dataset(spark, path)
    assert stored.count() == df.count()
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    # January is summer in the south.
    assert {r["estacion"] for r in stored.select("estacion").distinct().collect()} == {2}


def test_a_late_file_is_merged_into_its_days(spark, tmp_path):
    """Half a day added twice leaves the other half; the new row of a slot wins; ends follow."""
    path = str(tmp_path / "merged")
    df = pv_weather(spark, days=3)
    morning = df.where((F.dayofmonth("slot") == 3) & (F.hour("slot") < 12))
    writers.write_dataset(df.where((F.dayofmonth("slot") == 2) | ((F.dayofmonth("slot") == 3) & (F.hour("slot") >= 12))), path, touched_days_only=True)
    for factor in (1, 2):
        writers.write_dataset(morning.withColumn("power (kW)", F.col("power (kW)") * factor), path, touched_days_only=True)
    stored = readers.load_dataset(spark, path)
    assert stored.count() == df.where(F.dayofmonth("slot") <= 3).count() == stored.select("plant_id", "slot").distinct().count()
    total = lambda rows: rows.agg(F.round(F.sum("power (kW)"), 6)).first()[0]
    day = F.dayofmonth("slot") == 3
    assert total(stored.where(day & (F.hour("slot") < 12))) == pytest.approx(2 * total(morning))
    assert total(stored.where(day & (F.hour("slot") >= 12))) == total(df.where(day & (F.hour("slot") >= 12)))
    ends = {r.plant_id: r._end for r in readers.load_ends(spark, path).collect()}
    assert ends == {r.plant_id: r._end for r in views.series_ends(stored).collect()}
    writers.write_dataset(df.where(F.dayofmonth("slot") == 4), path, touched_days_only=True)
    stored = readers.load_dataset(spark, path)
    assert {tuple(r) for r in readers.load_ends(spark, path).collect()} == {tuple(r) for r in views.series_ends(stored).collect()}
    writers.write_dataset(df.where("false"), path, touched_days_only=True)
    assert readers.load_dataset(spark, path).count() == df.count()


def test_stored_ends_know_an_as_of(spark, tmp_path):
    path = str(tmp_path / "asof")
    df = pv_weather(spark, days=4)
    wrong = df.limit(1).withColumn("slot", F.lit("2099-05-05 10:00:00").cast("timestamp_ntz"))
    writers.write_dataset(df.unionByName(wrong), path)
    at = dt.datetime(2023, 1, 3, 9, 30)
    stored = readers.load_dataset(spark, path)
    assert {tuple(r) for r in readers.load_ends(spark, path, at).collect()} == {tuple(r) for r in views.series_ends(stored, as_of=at).collect()}
    assert readers.load_ends(spark, path).first()["_end"].year == 2099


def test_an_evaluation_knows_its_data_and_options(spark):
    df = pv_weather(spark, days=2)
    name = pipeline.evaluation_folder
    assert name(df, "s", {"k": 3}) == name(df.repartition(3), "s/", {"k": 3}) != name(df, "s", {"k": 2})
    other = df.withColumn("ghi", F.when(F.col("slot") == "2023-01-02 03:00:00", 1.0).otherwise(F.col("ghi")))
    assert len({name(x, "s", {}) for x in (df, other, df.unionByName(df), df.where("ghi > 0"))}) == 4


def test_each_file_is_read_as_what_it_is(spark, tmp_path):
    """Files of many lines are split among tasks, documents of many lines stay whole; broken ones are told in both."""
    folder = tmp_path / "mixed"
    put(folder / "plant_id=A", "whole.json", document(MAP))
    put(folder / "plant_id=A", "one_line.json", json.dumps(document(PAIRS)))
    line = json.dumps(document({f"2024-01-01 {h:02d}:00": h for h in range(24)}))
    lines = [line] * 3000
    lines[7] = "{bad"
    put(folder / "plant_id=B", "many.json", "\n".join(lines) + "\n")
    kinds = {os.path.basename(f): k for f, k in readers.file_kinds(spark, str(folder))}
    assert kinds == {"whole.json": "document", "one_line.json": "document", "many.json": "lines"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        raw = readers.read_generation(spark, str(folder), multi_line=None)
        parts = [r[0] for r in raw.where("plant_id = 'B'").select(F.spark_partition_id(), "eToday").collect()]
        assert len(set(parts)) > 3 and len(parts) == 3000
        assert sorted(r.plant_id for r in readers.good_rows(raw).collect()) == ["A"] * 2 + ["B"] * 2999
        assert len(readers.corrupt_rows(raw).collect()) == 1
        assert readers.explode_series(readers.good_rows(raw)).where("plant_id = 'B'").count() == 2999 * 24
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    only = readers.read_generation(spark, str(folder / "plant_id=B"), multi_line=None)
    assert len(only.select("eToday").collect()) == 3000
