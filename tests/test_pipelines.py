import pytest
from pyspark.sql import functions as F

from loggrove import schemas
from loggrove.operators import ledger, period, routing, typed, wide
from loggrove.operators.file_sets import match_file_sets, orphan_files
from loggrove.plans.pipelines import ingest_devices, ingest_matches, ingest_system, summarize
from loggrove.sources import staged

PREFIXES = routing.Prefixes("MetaData", "NT:R/", "NT:/P/", "NT:/FMSInfo/", ("NT:/pv/",), ("NT:/pv/", "NT:/cp/"))
DEVICE_MAP = [("V", "VOLTAGE"), ("C", "CURRENT"), ("S", "VELOCITY"), ("W", "POWER")]
# timestamp, entry, type, value: one session with two active spells
SESSION = [
    (100, "DS:enabled", "boolean", "False"), (1000, "DS:enabled", "boolean", "True"), (1000, "NT:R/V", "double", "13.0"), (1500, "NT:R/V", "double", "12.0"),
    (1500, "NT:R/C", "double", "3.0"), (1500, "NT:R/C", "double", "5.0"), (2000, "NT:R/S", "double", "-4.0"), (2500, "NT:R/S", "double", "2.0"),
    (2500, "NT:R/V", "double", "nan"), (2600, "NT:R/W", "double", "0.7"), (2700, "NT:R/unmapped", "double", "1"), (3000, "DS:enabled", "boolean", "False"),
    (4000, "DS:enabled", "boolean", "True"), (4500, "NT:R/V", "double", "11.0"), (5000, "DS:enabled", "boolean", "False"), (5000, "NT:R/V", "double", "9.0"),
    (1, "MetaData/x", "string", "Project Name: robot"), (2, "MetaData/x", "string", "no pair"), (3, "NT:/FMSInfo/EventName", "string", "old"),
    (4, "NT:/FMSInfo/EventName", "string", "EV"), (5, "NT:/FMSInfo/MatchNumber", "int64", "12"), (6, "NT:/P/gain", "double", "0.1"),
    (2000, "NT:/pv/cam/lat", "double", "20.0"), (2000, "NT:/pv/cam/hit", "boolean", "True"), (2100, "NT:/pv/cam/lat", "double", "22.0"),
]
WIDE = [(500, 12.0, 3.0, None), (500, 12.0, 5.0, None), (1000, None, None, -4.0), (1500, None, None, 2.0), (1600, None, None, None), (3500, 11.0, None, None)]


def long_frame(spark, name, rows):
    return spark.createDataFrame([(name, k, e, t, v, ts) for k, (ts, e, t, v) in enumerate(rows)], schemas.LONG)


@pytest.fixture(scope="module")
def maps(spark):
    devices = spark.createDataFrame([(e, "ELEVATOR", None, None, "LEAD MOTOR", m) for e, m in DEVICE_MAP], schemas.DEVICE_MAP)
    vision = spark.createDataFrame([("cam/lat", "CAM", "LATENCY"), ("cam/hit", "CAM", "HAS_TARGET")], schemas.VISION_MAP)
    return devices, vision


def wide_rows(frame):
    rows = frame.select("match_time", "voltage", "current", "velocity").collect()
    return sorted(map(tuple, rows), key=repr)


def test_system_import_of_two_files_is_the_union_of_single_runs(spark, maps):
    one, two = long_frame(spark, "a", SESSION), long_frame(spark, "b", [(ts + 7, *rest) for ts, *rest in SESSION])
    both = ingest_system(one.unionByName(two), *maps, PREFIXES, "2025")
    single = [ingest_system(f, *maps, PREFIXES, "2025") for f in (one, two)]
    assert wide_rows(single[0]["device_telemetry"]) == sorted(WIDE, key=repr)
    stats = single[0]["device_stats"].first()
    assert (stats.avg_voltage, stats.min_voltage, stats.max_voltage, round(stats.stddev_voltage, 6)) == (11.5, 11, 12, 0.707107)
    assert (stats.avg_velocity, stats.min_velocity, stats.max_velocity, stats.avg_temperature, stats.event, stats.match_id, stats.event_year) == (3, -4, 2, None, "EV", "12", "2025")
    sight = single[0]["vision_stats"].first()
    assert (sight.camera, sight.avg_latency) == ("CAM", 21.0)
    assert sorted(map(tuple, single[0]["vision_telemetry"].select("match_time", "latency", "hasTarget").collect())) == [(1000, 20.0, "True"), (1100, 22.0, None)]
    meta = single[0]["log_metadata"].first()
    assert (meta.project_name, meta.event, meta.station_num) == ("robot", "EV", None)
    for name, table in both.items():
        alone = single[0][name].unionByName(single[1][name])
        assert table.exceptAll(alone).isEmpty() and alone.exceptAll(table).isEmpty(), name


@pytest.mark.parametrize("drop, open_end, times", [((3000, 5000), "drop", []), ((3000, 5000), "keep", [500, 500, 1000, 1500, 1600, 3500, 4000]), ((1000, 4000), "drop", [])])
def test_open_and_missing_periods(spark, maps, drop, open_end, times):
    rows = [r for r in SESSION if not (r[1] == "DS:enabled" and r[0] in drop)]
    found = ingest_system(long_frame(spark, "a", rows), *maps, PREFIXES, open_end=open_end)["device_telemetry"]
    assert sorted(r.match_time for r in found.collect()) == times


def test_matches_use_the_system_period_for_all_files(spark, maps):
    files = spark.createDataFrame([(f"/in/{n}",) for n in ("log_Q12.wpilog", "drive_Q12_1.hoot", "rio_Q12_1.hoot", "drive_Q9_1.hoot", "x.txt")], "path string")
    device = [(1500, "V", "double", "10"), (900, "V", "double", "1"), (5000, "V", "double", "1")]
    out = ingest_matches(long_frame(spark, "log_Q12.wpilog", SESSION), long_frame(spark, "drive_Q12_1.hoot", device), long_frame(spark, "rio_Q12_1.hoot", device), files, maps[0], maps[0], maps[1], PREFIXES, "2025")
    rows = out["device_telemetry"].select("filename", "match_time", "voltage", "match_id").collect()
    assert sorted(map(tuple, rows)) == [("drive_Q12_1.hoot", 500, 10.0, "12"), ("rio_Q12_1.hoot", 500, 10.0, "12")]
    assert out["log_metadata"].count() == 3 and out["vision_telemetry"].count() == 2
    assert [tuple(r) for r in match_file_sets(files).collect()] == [("Q12", ["/in/log_Q12.wpilog"], ["/in/drive_Q12_1.hoot"], ["/in/rio_Q12_1.hoot"])]
    assert [r.path for r in orphan_files(files).collect()] == ["/in/drive_Q9_1.hoot"]


def test_devices_have_a_clock_of_their_own(spark, maps):
    rio_map = maps[0].withColumn("subsystem", F.lit("RIO"))
    rows = [(50, "V", "double", "1"), (60, "V", "double", "2")]
    out = ingest_devices(long_frame(spark, "drive_1", rows).unionByName(long_frame(spark, "rio_1", [(9, "V", "double", "4")])), maps[0], rio_map)
    assert sorted(map(tuple, out["device_telemetry"].select("filename", "subsystem", "match_time", "voltage").collect())) == [("drive_1", "ELEVATOR", 0, 1.0), ("drive_1", "ELEVATOR", 10, 2.0), ("rio_1", "RIO", 0, 4.0)]


def test_two_ways_to_widen_agree(spark):
    rows = [(k % 3 or None, k % 4, m, float(k)) for k in range(60) for m in ("A", "B", None) if (k + len(m or "")) % 3]
    frame = spark.createDataFrame(rows, "x long, y long, metric string, v double")
    columns = {"a": ("A", "v"), "b": ("B", "v"), "c": ("C", "v")}
    p, q = wide.widen(frame, ["x", "y"], columns), wide.widen_by_joins(frame, ["x", "y"], columns)
    assert p.exceptAll(q).isEmpty() and q.exceptAll(p).isEmpty() and p.count() > 100


def test_summary_counts_text_as_zero_and_excludes_the_floor(spark):
    base = ("EV", "1", "S", None, "T", "C", "CURRENT", "double")
    rows = [(*base, "0.05", 0.05), (*base, "-2", -2.0), (*base, "1", 1.0), (*base, "text", 9.0), (*base, None, 9.0), (*base[:7], "int64", "5", 5.0)]
    frame = spark.createDataFrame(rows, "event string, match_id string, subsystem string, assembly string, subassembly string, component string, metric string, data_type string, value string, numeric_value double")
    got = summarize(frame).collect()
    assert [(r.part, r.type, r.max_abs_value, r.min_abs_value, r.avg_abs_value) for r in got] == [(None, "T", 2.0, 1.0, 1.5)]
    old = summarize(frame)
    again = ledger.upsert(old, old, ["event", "match_id", "subsystem", "component", "part", "type", "metric"])
    assert again.exceptAll(old).isEmpty() and again.count() == 1


def test_strict_forms_raise(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed.typed_values(spark.createDataFrame([("double", "x")], "data_type string, value string"), strict=True).collect()
    lines = spark.createDataFrame([("f", 1, "e", "x")], "filename string, seq int, entry string, value string")
    with pytest.raises(Exception, match="key: value"):
        routing.session_metadata(lines, lines, strict=True).collect()
    with pytest.raises(ValueError):
        schemas.conform(lines, schemas.VISION_MAP)
    assert typed.unparsed(spark.createDataFrame([("double", "x"), ("int64", "1")], "data_type string, value string")).count() == 1


def test_last_value_wins_even_if_null(spark):
    rows = spark.createDataFrame([("s", "k", "1", 1), ("s", "k", None, 2), ("s", "l", "3", 1)], "s string, key string, value string, seq int")
    assert tuple(routing.pivot_last(rows, ["s"], "key", "value", "seq", {"k": "k", "l": "l", "m": "m"}).first()) == ("s", None, "3", None)


def test_both_clocks_agree(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 9), (None, 3), (None, 4)], "filename string, timestamp long")
    assert sorted(map(repr, period.file_clock(rows, ["filename"]).collect())) == sorted(map(repr, period.file_clock_window(rows, ["filename"]).collect()))


def test_staged_records_keep_their_file(spark, tmp_path):
    both = long_frame(spark, "f1", [(1, "a", "double", "1"), (2, "b", "double", "2")]).unionByName(long_frame(spark, "007", [(3, "c", "double", "3")]))
    staged.write_staged(both.repartition(3), str(tmp_path / "s"))
    for path in (tmp_path / "s", tmp_path / "s" / "*"):
        got = staged.read_staged(spark, str(path)).select("filename", "entry").collect()
        assert sorted(map(tuple, got)) == [("007", "c"), ("f1", "a"), ("f1", "b")]


def test_only_decimal_numbers_are_numbers(spark):
    from loggrove.functions.text import number

    texts = ["1", " 2.5e3 ", ".5", "7.", "-inf", "1d", "2f", "0x1p3", "", "nan", None, "1 2"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(number(F.col("t"))).collect()
    assert [r[0] for r in got] == [1.0, 2500.0, 0.5, 7.0, float("-inf")] + [None] * 7


def test_staged_records_round_trip(spark, tmp_path):
    rows = [(1, "e,1", "string", "x, |y|"), (2, "e2", "double", "nan"), (3, "e3", "string", 'q"t')]
    staged.write_staged(long_frame(spark, "f1", rows), str(tmp_path / "s"))
    got = staged.read_staged(spark, str(tmp_path / "s" / "*"))
    assert sorted(map(tuple, got.select("entry", "value", "timestamp").collect())) == [("e,1", "x, |y|", 1), ("e2", None, 2), ("e3", 'q"t', 3)]
    (tmp_path / "m.csv").write_text("entry,subsystem,assembly,subassembly,component,metric\na,S,,,C,VOLTAGE\n\nb,S,C,VELOCITY\n")
    assert [tuple(r) for r in staged.read_map(spark, str(tmp_path / "m.csv"), schemas.DEVICE_MAP).collect()] == [("a", "S", None, None, "C", "VOLTAGE"), ("b", "S", "C", "VELOCITY", None, None)]
    (tmp_path / "c.json").write_text('{"metadata_prefix": "M",\n"metrics_prefix": "R", "preferences_prefix": "P", "fms_prefix": "F", "photon_prefix": "V", "camerapub_prefix": "C"}')
    assert routing.Prefixes.read(spark, str(tmp_path / "c.json"), both_vision=True).vision == ("V", "C")


def test_replacing_a_partition_twice_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([("f", "e", "double", "1"), ("g", "e", "double", "2")], "filename string, entry string, data_type string, value string")
    for _ in range(2):
        staged.replace_partitions(rows, table, schemas.PREFERENCES, ["filename"])
    staged.replace_partitions(rows.where("filename = 'g'").withColumn("value", F.lit("3")), table, schemas.PREFERENCES, ["filename"])
    assert sorted((r.filename, r.value) for r in spark.read.parquet(table).collect()) == [("f", "1"), ("g", "3")]


def test_tables_are_appended_exported_and_named(spark, tmp_path):
    rows = spark.createDataFrame([("f", "e", "double", "1")], "filename string, entry string, data_type string, value string")
    for _ in range(2):
        staged.append_table(rows, str(tmp_path / "w" / "preferences"), schemas.PREFERENCES, ["filename"])
    staged.register_tables(spark, str(tmp_path / "w"), ["preferences"])
    assert [tuple(r) for r in spark.sql("select filename, value, event from preferences").collect()] == [("f", "1", None)] * 2
    staged.export_csv(rows, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("f", "e", "double", "1")]
    staged.write_staged_parquet(long_frame(spark, "f1", SESSION), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).select(schemas.LONG.names).exceptAll(long_frame(spark, "f1", SESSION)).isEmpty()
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [(r.filename, r.file_hash[:8]) for r in staged.file_hashes(spark, str(tmp_path / "x.bin")).collect()] == [("x.bin", "ba7816bf")]


def test_what_no_route_or_line_takes_is_listed(spark):
    rows = spark.createDataFrame([("f", "MetaData/x", "a: b"), ("f", "MetaData/x", "none"), ("f", None, "c: d")], "filename string, entry string, value string")
    assert [r.value for r in routing.unrouted(rows).collect()] == ["c: d"] and [r.value for r in routing.malformed_metadata(rows).collect()] == ["none"]
