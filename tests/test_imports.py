import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from loggrove import schemas
from loggrove.operators import ledger
from loggrove.plans import imports
from loggrove.plans.imports import import_devices, import_matches, import_staged, import_systems, match_tables, read_counts, read_table, store_summary, summary_table
from loggrove.plans.pipelines import ingest_matches, ingest_system, summarize, system_raw
from loggrove.sources import staged
from loggrove.sources.container import long_records
from loggrove.streaming.incremental import choose, import_new, ledger_attempts, read_ledger
from tests.logs import header, record, start
from tests.test_pipelines import PREFIXES, SESSION, long_frame, maps  # noqa: F401

TABLES = ("log_metadata", "device_data_raw", "device_telemetry", "device_stats", "vision_data_raw", "vision_telemetry", "vision_stats", "preferences")


def container(rows):
    """A log file of (timestamp, entry, type, value) rows of numbers, flags and texts."""
    pack = {"double": lambda v: struct.pack("<d", float(v)), "int64": lambda v: struct.pack("<q", int(v)), "boolean": lambda v: bytes([v == "True"]), "string": str.encode}
    names = {e: k + 1 for k, e in enumerate(dict.fromkeys(r[1] for r in rows))}
    kinds = {e: t for _, e, t, _ in rows}
    return header() + b"".join(start(k, e, kinds[e]) for e, k in names.items()) + b"".join(record(names[e], ts, pack[t](v)) for ts, e, t, v in rows)


def later(rows, by):
    return [(ts + by, *rest) for ts, *rest in rows]


def same(found, wanted):
    """Whether both have the same rows; sums of doubles may differ in their last digits."""
    columns = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in wanted.dtypes]
    found, wanted = found.select(columns), wanted.select(columns)
    return found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def write(folder, name, content, modified=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content)
    if modified:
        os.utime(path, (modified, modified))


def outcomes(spark, root):
    return {r.filename: (r.success, r.outcome) for r in read_ledger(spark, f"{root}/ledger").collect()}


def test_each_content_is_imported_once(spark, tmp_path):
    logs, root = str(tmp_path / "logs"), str(tmp_path / "root")
    log = header() + start(1, "V", "int64") + record(1, 5, struct.pack("<q", 1))
    write(logs, "a.wpilog", log)
    write(logs, "b.wpilog", log)
    loaded = []

    def run():
        import_new(spark, logs, root, lambda f, r, n: loaded.extend((x.filename, n) for x in f.collect())).awaitTermination()

    run()
    write(logs, "c.wpilog", log)
    write(logs, "d.wpilog", log + record(1, 6, struct.pack("<q", 2)))
    run()
    assert loaded == [("a.wpilog", 0), ("d.wpilog", 2)]
    assert outcomes(spark, root) == {"a.wpilog": (True, "imported"), "d.wpilog": (True, "imported")}
    assert long_records(spark, f"{logs}/d.wpilog").count() == 2


def test_a_folder_of_system_logs_is_imported_once(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    write(logs, "log_Q1.wpilog", container(SESSION))
    write(logs, "copy.wpilog", container(SESSION))
    write(logs, "broken.wpilog", b"no log")
    run = lambda: import_systems(spark, logs, root, *maps, PREFIXES, "2025").awaitTermination()
    run()
    write(logs, "log_Q2.wpilog", container(later(SESSION, 7)))
    run()
    # the smaller name of one content
    both = long_frame(spark, "copy.wpilog", SESSION).unionByName(long_frame(spark, "log_Q2.wpilog", later(SESSION, 7)))
    for name, rows in ingest_system(both, *maps, PREFIXES, "2025").items():
        if name not in ("device_data_raw", "vision_data_raw"):
            assert same(read_table(spark, root, name), rows), name
    assert outcomes(spark, root) == {"copy.wpilog": (True, "imported"), "broken.wpilog": (False, "not a log"), "log_Q2.wpilog": (True, "imported")}
    counts = {(r.attempt_id, r.counter): r.n for r in read_counts(spark, root).collect()}
    assert (counts[0, "files"], counts[0, "decoded"], counts[0, "malformed_metadata"], counts[0, "misfit"], counts[2, "files"]) == (1, len(SESSION), 1, 0, 1)


def test_what_an_import_leaves_out_is_counted(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    odd = record(0, 1, b"\0\1") + start(90, "NT:R/X", "double") + record(90, 5, b"short") + start(91, "NT:R/Y", "struct:pose") + record(91, 6, b"x") + start(92, "MetaData/y", "string") + record(92, 7, b"no pair here")
    write(logs, "log_Q1.wpilog", container(SESSION) + odd)
    import_systems(spark, logs, root, *maps, PREFIXES, "2025").awaitTermination()
    counts = {r.counter: r.n for r in read_counts(spark, root).collect()}
    assert counts == {"files": 1, "invalid_control": 1, "records": len(SESSION) + 1, "decoded": len(SESSION) + 1, "misfit": 1, "unhandled": 1, "unrouted": 0, "unparsed": 0, "malformed_metadata": 2}


def test_two_contents_of_one_name_never_mix(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    old, new, newest = container(SESSION), container(later(SESSION, 7)), container(later(SESSION, 100)[:-3])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    write(f"{logs}/a", "x_Q1.wpilog", new, 2_000)
    write(f"{logs}/b", "x_Q1.wpilog", old, 1_000)
    run = lambda: import_systems(spark, f"{logs}/*", root, *maps, PREFIXES, "2025").awaitTermination()

    def holds(content, rows):
        wanted = ingest_system(long_frame(spark, "x_Q1.wpilog", rows), *maps, PREFIXES, "2025")
        assert all(same(read_table(spark, root, t), wanted[t]) for t in TABLES if not t.endswith("raw"))
        assert [(r.file_hash, r.success) for r in read_ledger(spark, f"{root}/ledger").collect()] == [(digest(content), True)]

    run()
    holds(new, later(SESSION, 7))
    # a version that is older than the imported one, in a later batch
    write(f"{logs}/c", "x_Q1.wpilog", container(later(SESSION, 3)), 500)
    run()
    holds(new, later(SESSION, 7))
    write(f"{logs}/d", "x_Q1.wpilog", newest, 3_000)
    run()
    holds(newest, later(SESSION, 100)[:-3])
    lost = ledger_attempts(spark, f"{root}/ledger").where("outcome = 'superseded'").collect()
    assert {r.file_hash for r in lost} == {digest(old), digest(container(later(SESSION, 3)))}


def test_choice_of_versions(spark):
    facts = [("p1", "a", "h1", 5, True), ("p2", "a", "h2", 5, True), ("p3", "b", "h2", 1, True), ("p4", "c", "h3", 9, False), ("p5", "d", "h4", 1, True), ("p6", "e", "h5", 4, True), ("p7", "f", "h6", 3, True)]
    done = [("d", 0, "h9", True, 0, 1, 2, "imported"), ("e", 0, "h8", True, 0, 1, 3, "imported"), ("z", 0, "h6", True, 0, 1, 1, "imported"), ("y", 0, "h1", False, 0, 1, 1, "started")]
    known = spark.createDataFrame(done, schemas.LEDGER)
    got = choose(spark.createDataFrame(facts, "path string, filename string, file_hash string, modified long, is_log boolean"), known)
    assert {k: sorted(r.path for r in v.collect()) for k, v in got.items()} == {"not a log": ["p4"], "superseded": ["p1", "p5"], "chosen": ["p2", "p6"]}
    every = choose(spark.createDataFrame(facts, "path string, filename string, file_hash string, modified long, is_log boolean"), known, skip_imported=False)
    assert sorted(r.path for r in every["chosen"].collect()) == ["p2", "p3", "p6", "p7"]


def test_a_run_that_breaks_off_is_an_unsuccessful_attempt_and_is_done_again(spark, tmp_path, maps, monkeypatch):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    write(logs, "log_Q1.wpilog", container(SESSION))
    real = imports.derived_tables
    monkeypatch.setattr(imports, "derived_tables", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        import_systems(spark, logs, root, *maps, PREFIXES).awaitTermination()
    assert outcomes(spark, root) == {"log_Q1.wpilog": (False, "started")}
    monkeypatch.setattr(imports, "derived_tables", real)
    import_systems(spark, logs, root, *maps, PREFIXES).awaitTermination()
    assert outcomes(spark, root) == {"log_Q1.wpilog": (True, "imported")}
    wanted = ingest_system(long_frame(spark, "log_Q1.wpilog", SESSION), *maps, PREFIXES)
    assert all(same(read_table(spark, root, t), wanted[t]) for t in TABLES if not t.endswith("raw"))


def test_a_folder_of_device_logs_is_imported_even_with_a_new_checkpoint(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), tmp_path / "tables"
    write(logs, "drive_1.wpilog", container([(50, "V", "double", "1"), (60, "V", "double", "2")]))
    import_devices(spark, logs, str(root), maps[0], maps[0]).awaitTermination()
    (root / "checkpoint").rename(root / "old")
    write(logs, "rio_1.wpilog", container([(9, "V", "double", "4")]))
    import_devices(spark, logs, str(root), maps[0], maps[0]).awaitTermination()
    rows = read_table(spark, str(root), "device_telemetry").select("filename", "match_time", "voltage").collect()
    assert sorted(map(tuple, rows)) == [("drive_1.wpilog", 0, 1.0), ("drive_1.wpilog", 10, 2.0), ("rio_1.wpilog", 0, 4.0)]
    assert sorted((r.filename, r.attempt_id) for r in read_ledger(spark, f"{root}/ledger").collect()) == [("drive_1.wpilog", 1), ("rio_1.wpilog", 3)]


DEVICE = [(1500, "V", "double", "10"), (900, "V", "double", "1"), (5000, "V", "double", "1"), (2000, "C", "double", "3")]


def test_late_files_give_the_rows_of_a_full_run(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    files = {"log_Q12.wpilog": SESSION, "drive_Q12_1.hoot": DEVICE, "rio_Q12_1.hoot": later(DEVICE, 3), "drive_Q9_1.hoot": DEVICE, "log_Q7.wpilog": later(SESSION, 11)}
    device, vision = maps
    run = lambda to, **kw: import_matches(spark, logs, to, device, device, vision, PREFIXES, "2025", **kw).awaitTermination()
    for name in ("log_Q12.wpilog", "drive_Q12_1.hoot", "drive_Q9_1.hoot"):
        write(logs, name, container(files[name]))
    write(logs, "notes.txt", container(SESSION))
    run(root)
    done = outcomes(spark, root)
    assert done == {"log_Q12.wpilog": (True, "imported"), "drive_Q12_1.hoot": (True, "imported"), "drive_Q9_1.hoot": (False, "waiting"), "notes.txt": (False, "unmatched")}
    first = [sorted(map(str, read_table(spark, root, t).collect())) for t in TABLES]
    attempts = ledger_attempts(spark, f"{root}/ledger").count()
    run(root)
    assert [sorted(map(str, read_table(spark, root, t).collect())) for t in TABLES] == first and ledger_attempts(spark, f"{root}/ledger").count() == attempts
    for name in ("rio_Q12_1.hoot", "log_Q7.wpilog"):
        write(logs, name, container(files[name]))
    run(root)
    listing = spark.createDataFrame([(f"{logs}/{n}",) for n in files], "path string")
    union = lambda *names: long_frame(spark, names[0], files[names[0]]) if len(names) == 1 else long_frame(spark, names[0], files[names[0]]).unionByName(union(*names[1:]))
    wanted = ingest_matches(union("log_Q12.wpilog", "log_Q7.wpilog"), union("drive_Q12_1.hoot", "drive_Q9_1.hoot"), union("rio_Q12_1.hoot"), listing, device, device, vision, PREFIXES, "2025")
    for name in TABLES:
        if not name.endswith("raw"):
            assert same(read_table(spark, root, name), wanted[name]), name
    assert {r.filename for r in read_table(spark, root, "device_telemetry").collect()} == {"drive_Q12_1.hoot", "rio_Q12_1.hoot"}
    # the system log of the waiting match
    write(logs, "log_Q9.wpilog", container(later(SESSION, 1)))
    run(root)
    assert outcomes(spark, root)["drive_Q9_1.hoot"] == (True, "imported")
    assert {r.filename for r in read_table(spark, root, "device_telemetry").collect()} == {"drive_Q12_1.hoot", "rio_Q12_1.hoot", "drive_Q9_1.hoot"}


def test_a_match_may_wait_for_all_its_kinds_and_a_new_system_log_takes_over(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    device, vision = maps
    run = lambda: import_matches(spark, logs, root, device, device, vision, PREFIXES, need=("system", "drive", "rio")).awaitTermination()
    write(logs, "a_Q1.wpilog", container(SESSION))
    write(logs, "drive_Q1_1.hoot", container(DEVICE))
    run()
    assert set(outcomes(spark, root).values()) == {(False, "waiting")} and read_table(spark, root, "log_metadata").isEmpty()
    write(logs, "rio_Q1_1.hoot", container(later(DEVICE, 1)))
    run()
    assert set(outcomes(spark, root).values()) == {(True, "imported")}
    assert sorted(r.match_time for r in read_table(spark, root, "device_telemetry").where("filename = 'drive_Q1_1.hoot'").collect()) == [500, 1000]
    write(logs, "b_Q1.wpilog", container(later(SESSION, 200)))
    run()
    assert sorted(r.match_time for r in read_table(spark, root, "device_telemetry").where("filename = 'drive_Q1_1.hoot'").collect()) == [300, 800, 3800]
    assert {r.filename for r in read_table(spark, root, "log_metadata").collect()} == {"b_Q1.wpilog", "drive_Q1_1.hoot", "rio_Q1_1.hoot"}
    assert {r.filename for r in read_table(spark, root, "vision_data_raw").collect()} == {"b_Q1.wpilog"}


def test_staged_records_import_as_their_logs_do(spark, tmp_path, maps):  # noqa: F811
    many = [(10 * k, "NT:R/V" if k % 3 else "NT:/FMSInfo/EventName", "double" if k % 3 else "string", str(k)) for k in range(200, 700)]
    records = long_frame(spark, "a b+%.wpilog", SESSION + many).unionByName(long_frame(spark, "c.wpilog", later(SESSION, 7)))
    path, root = str(tmp_path / "staged"), str(tmp_path / "tables")
    staged.write_staged(records.repartition(7), path)
    parts = [f for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(parts) > 2  # a file's records lie in several
    read = staged.read_staged(spark, path)
    wanted = ingest_system(records, *maps, PREFIXES, "2025")
    found = ingest_system(read, *maps, PREFIXES, "2025")
    for name in TABLES:
        columns = [c for c in wanted[name].columns if c != "value"]
        assert same(found[name].select(columns), wanted[name].select(columns)), name
    raw = lambda rows: system_raw(rows, *maps, PREFIXES, "2025")
    for _ in range(2):
        import_staged(spark, read, root, raw, PREFIXES.metadata)
    assert all(same(read_table(spark, root, t), found[t]) for t in TABLES)
    assert outcomes(spark, root) == {"a b+%.wpilog": (True, "imported"), "c.wpilog": (True, "imported")} and ledger_attempts(spark, f"{root}/ledger").count() == 4


def test_foreign_staged_files_have_the_order_of_their_lines(spark, tmp_path):
    lines = [f"e{k},string,|v {k}, ||x|| |,{k % 5}" for k in range(5000)]
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.csv").write_text("\n".join(lines[:10]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = staged.read_staged(spark, str(tmp_path / "*.csv"))
        assert read.rdd.getNumPartitions() > 5
        rows = sorted(read.select("filename", "seq", "entry").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.entry for r in rows if r.filename == "one.csv"] == [f"e{k}" for k in range(5000)]
    assert [r.entry for r in rows if r.filename == "two.csv"] == [f"e{k}" for k in range(10)]
    assert len({r.seq for r in rows if r.filename == "one.csv"}) == 5000


def test_the_stored_summary_is_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "root")
    columns = "event string, match_id string, subsystem string, assembly string, subassembly string, component string, metric string, data_type string, value string, numeric_value double"
    rows = lambda v, match="1": spark.createDataFrame([("EV", match, "S", None, "T", "C", "CURRENT", "double", str(v), float(v)), ("EV", "2", None, None, None, "C", "TEMP", "double", "3", 3.0)], columns)
    for _ in range(2):
        store_summary(spark, root, rows(2))
    assert same(summary_table(root).read(spark), summarize(rows(2)))
    store_summary(spark, root, rows(7))
    assert same(summary_table(root).read(spark), summarize(rows(7)))
    with pytest.raises(Exception, match="broken"):
        store_summary(spark, root, rows(9).withColumn("numeric_value", F.raise_error(F.lit("broken")).cast("double")))
    assert same(summary_table(root).read(spark), summarize(rows(7)))
    store_summary(spark, root, rows(1, "3"))
    assert summary_table(root).read(spark).count() == 3


def test_match_tables_need_no_more_than_files_and_records(spark, maps):  # noqa: F811
    files = spark.createDataFrame([("log_Q1.wpilog", "/i/log_Q1.wpilog", "system"), ("rio_Q1_1.hoot", "/i/rio_Q1_1.hoot", "rio")], "filename string, path string, kind string")
    records = long_frame(spark, "log_Q1.wpilog", SESSION).unionByName(long_frame(spark, "rio_Q1_1.hoot", DEVICE)).unionByName(long_frame(spark, "other.hoot", DEVICE))
    raw = match_tables(files, maps[0], maps[0], maps[1], PREFIXES)(records)
    assert sorted((r.filename, r.match_time) for r in raw["device_data_raw"].collect()) == [("rio_Q1_1.hoot", 500), ("rio_Q1_1.hoot", 1000)]


def test_what_all_tables_need_of_a_match_is_stored_once(spark, tmp_path, maps):  # noqa: F811
    device, vision = maps
    files = spark.createDataFrame([("log_1.wpilog", "/in/log_1.wpilog", "system", "1")], "filename string, path string, kind string, match_id string")
    records = long_frame(spark, "log_1.wpilog", SESSION)
    lazy = match_tables(files, device, device, vision, PREFIXES, "2025")(records)
    kept = match_tables(files, device, device, vision, PREFIXES, "2025", root=str(tmp_path))(records)
    assert lazy["log_metadata"].count() == 1 and all(same(kept[t], lazy[t]) for t in lazy)
    stored = {t: {p.split("/work/")[1].split("/")[0] for p in kept[t].inputFiles() if "/work/" in p} for t in kept}
    assert stored["log_metadata"] == {"metadata"} and stored["device_data_raw"] == {"sets", "metadata", "period"}


def test_ledger_helpers(spark):
    rows = spark.createDataFrame([("a", "h", 1), ("a", "k", 1), ("b", "h", 3)], "filename string, file_hash string, modified long")
    assert sorted(map(tuple, ledger.newest_versions(rows).collect())) == [("a", "k", 1), ("b", "h", 3)]
    assert sorted(map(tuple, ledger.one_of_content(rows).collect())) == [("a", "h", 1), ("a", "k", 1)]


def test_a_log_without_records_and_files_without_a_match_import_as_nothing(spark, tmp_path, maps):  # noqa: F811
    logs, root = str(tmp_path / "logs"), str(tmp_path / "tables")
    write(logs, "empty_Q1.wpilog", header())
    import_systems(spark, logs, root, *maps, PREFIXES).awaitTermination()
    assert outcomes(spark, root) == {"empty_Q1.wpilog": (True, "imported")}
    assert read_table(spark, root, "records").isEmpty() and read_table(spark, root, "device_stats").isEmpty()
    others, matches = str(tmp_path / "others"), str(tmp_path / "matches")
    write(others, "notes.txt", header() + start(1, "V", "double"))
    import_matches(spark, others, matches, maps[0], maps[0], maps[1], PREFIXES).awaitTermination()
    assert outcomes(spark, matches) == {"notes.txt": (False, "unmatched")}
