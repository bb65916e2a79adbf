"""Registered queries over the given tables, each with the SQL of its result.

The tables stand in for telemetry: ``events`` is a mapped long table (session =
user_id, metric from event_type), ``lineitem``, ``orders`` and ``part`` serve
for joins, keys and upserts. Every query calls the library's operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loggrove.functions.text import seconds, wall_clock, without_prefix
from loggrove import schemas
from loggrove.operators import file_sets, ledger, period, routing, typed, wide
from loggrove.plans import imports, pipelines
from loggrove.sources import staged
from loggrove.sources.container import decode_values, resolve_entries
from loggrove.sources.shared import shared_folder
from loggrove.sources.stored import StoredTable
from loggrove.streaming.incremental import choose

# The metric that each event type stands for; signup is one outside the five.
METRIC_OF = {"click": "VOLTAGE", "error": "CURRENT", "view": "POSITION", "purchase": "VELOCITY", "signup": "POWER"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str = "ts") -> Column:
    """Microseconds of a timestamp without zone, taken as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def _metric() -> Column:
    return F.create_map(*[F.lit(x) for kv in METRIC_OF.items() for x in kv])[F.col("event_type")]


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def device_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", _metric().alias("metric"), (F.col("value") - F.when(F.col("event_type") == "purchase", 50).otherwise(0)).alias("numeric_value"))
    columns = {"voltage": "VOLTAGE", "current": "CURRENT", "velocity": "VELOCITY", "position": "POSITION", "temperature": "TEMP"}
    return _rounded(wide.metric_stats(events, ["user_id"], columns))


def device_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("nullif(user_id % 7, 0)").alias("component"), _metric().alias("metric"), F.col("value").alias("numeric_value"))
    columns = {c: (m, "numeric_value") for c, m in (("voltage", "VOLTAGE"), ("current", "CURRENT"), ("velocity", "VELOCITY"), ("position", "POSITION"), ("temperature", "TEMP"))}
    return wide.widen(events, ["user_id", "day", "component"], columns)


def _sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("event_type") == "click", "HAS_TARGET").when(F.col("event_type") == "view", "LATENCY").when(F.col("event_type") == "error", "PITCH")
    flag = F.when(F.col("event_type") == "click", F.when(F.col("value") > 50, "True").otherwise("False"))
    number = F.when(F.col("event_type") == "view", F.col("value"))
    return _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("nullif(user_id % 5, 0)").alias("camera"), "user_id", metric.alias("metric"), flag.alias("boolean_value"), number.alias("numeric_value"))


def vision_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"has_target": ("HAS_TARGET", "boolean_value"), "latency": ("LATENCY", "numeric_value")}
    return wide.widen(_sights(spark, sf_dir), ["user_id", "day", "camera"], columns)


def vision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(wide.camera_stats(_sights(spark, sf_dir), ["day"]))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long records of a session per user and week: signup enables,
    error disables, the others are metrics."""
    entry = F.when(F.col("event_type").isin("signup", "error"), "DS:enabled").otherwise(F.col("event_type"))
    value = F.when(F.col("event_type") == "signup", "True").when(F.col("event_type") == "error", "False").otherwise(F.col("value").cast("string"))
    at = _micros()
    return _table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(at / F.lit(604_800_000_000)).alias("week"), entry.alias("entry"), value.alias("value"), at.alias("timestamp"))


def match_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period.match_period(_signals(spark, sf_dir), ["user_id", "week"])


def _trimmed(spark: SparkSession, sf_dir: str, open_end: str) -> DataFrame:
    records = _signals(spark, sf_dir)
    return period.trim(records, period.match_period(records, ["user_id", "week"]), ["user_id", "week"], open_end=open_end).select("event_id", "user_id", "week", "timestamp", "match_time")


def trim_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, "drop")


def trim_open_end_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, "keep")


def file_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period.file_clock(_table(spark, sf_dir, "events").select("event_id", "user_id", _micros().alias("timestamp")), ["user_id"])


def entry_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("component"), F.col("p_type").alias("metric"))
    return typed.map_entries(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entry"), "l_quantity"), entries)


def map_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.when(F.col("p_size") <= 25, F.col("p_type")).alias("metric"))
    return typed.map_lint(_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entry")), entries)


_PREFIXES = routing.Prefixes("NT:signup", "NT:click/", "NT:purchase", "NT:error", ("NT:view/",), ("NT:view/",))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("NT:"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("entry"))


def route_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f.withColumn("route", F.lit(k)) for k, f in routing.route(_entries(spark, sf_dir), _PREFIXES).items()]
    return typed.union_frames(*parts)


def strip_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", without_prefix(F.col("entry"), "NT:", "view/", "1").alias("entry"))


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("boolean", "int64", "double", "string")]), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(F.col("event_id") % 4 == 0, F.when(F.col("value") > 50, "True").otherwise("False")).when(F.col("event_id") % 4 == 1, F.floor("value").cast("string")).when(F.col("event_id") % 12 == 2, "nan").when(F.col("event_id") % 12 == 6, "no number").when(F.col("event_id") % 4 == 2, F.floor(F.col("value") * 2).cast("string")).otherwise(F.col("props"))
    return typed.typed_values(_table(spark, sf_dir, "events").select("event_id", kind.alias("data_type"), value.alias("value")))


def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("filename"), F.col("o_orderpriority").alias("event"), F.col("o_custkey").cast("string").alias("match_id"), F.col("o_orderstatus").alias("match_type"), F.lit("0").alias("replay_num"))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("filename"), "l_linenumber", "l_quantity")
    return routing.with_match_keys(rows, keys, "2025")


def metadata_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 11 != 0, F.concat("event_type", F.lit(": "), F.col("event_id").cast("string"))).otherwise("no pair")
    lines = _table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), routing.key_value(value).alias("pair"))
    pairs = lines.select("user_id", "seq", F.col("pair.key").alias("key"), F.when(F.col("seq") % 5 != 0, F.col("pair.value")).alias("value"))
    return routing.pivot_last(pairs, ["user_id"], "key", "value", "seq", {k: f"last_{k}" for k in METRIC_OF})


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "finish").otherwise("data")
    records = _table(spark, sf_dir, "events").select("user_id", F.lit(1).alias("entry_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("name"), F.col("event_type").alias("type"))
    return resolve_entries(records, ["user_id"]).select("user_id", "seq", "name", "type")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), (F.col("doc_id") % 3 != 0).alias("success"))


def _even_ids(files: DataFrame, odd: bool) -> DataFrame:
    return files.where(F.col("doc_id") % 2 == int(odd))


def skip_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _hashed(spark, sf_dir)
    return ledger.not_imported(_even_ids(files, True).select("doc_id", "file_hash"), _even_ids(files, False)).select("doc_id", "file_hash")


def imported_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _hashed(spark, sf_dir)
    return ledger.already_imported(_even_ids(files, True).select("doc_id", "file_hash"), _even_ids(files, False)).select("doc_id", "imported_as")


def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", _micros("o_orderdate").alias("placed"), "o_orderkey", "o_orderstatus")
    return ledger.latest(orders, ["o_custkey"], ["placed", "o_orderkey"])


def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr("nullif(o_custkey % 9, 0)").alias("part"), "o_totalprice")
    total = lambda f: f.groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return ledger.upsert(total(orders.where("o_orderkey % 2 = 0")), total(orders.where("o_orderkey % 4 = 1 and o_custkey % 9 in (0, 1, 2)")), ["o_orderpriority", "part"])


def flush_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return ledger.without_files(lines, _table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")


def electrical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.element_at(F.array(*[F.lit(x) for x in ("CURRENT", "TEMP", "VOLTAGE", "POSITION")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    kind = F.when(F.col("l_suppkey") % 10 == 0, "int64").otherwise("double")
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", metric.alias("metric"), kind.alias("data_type"), F.when(F.col("l_suppkey") % 7 == 0, "text").otherwise(F.col("l_discount").cast("string")).alias("value"), (F.col("l_quantity") - 25).alias("numeric_value"))
    return _rounded(wide.electrical_summary(lines, ["l_returnflag", "l_linestatus", "metric"]))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"))
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("/in/log_"), "c", F.lit(".wpilog"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("/in/drive_"), "c", F.lit("_0301.hoot"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("/in/rio_"), "c", F.lit("_0301.hoot"))).otherwise(F.concat(F.lit("/in/notes_"), "c", F.lit(".txt")))
    return orders.select(name.alias("path"))


def match_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = file_sets.match_file_sets(_files(spark, sf_dir))
    return sets.select("match_id", *[F.array_join(k, "|").alias(k) for k in ("system", "drive", "rio")])


def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_sets.orphan_files(_files(spark, sf_dir)).select("path", "kind", "match_id")


def pipelines_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    drive = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.lit("drive").alias("filename"), "l_quantity")
    rio = lines.where("l_returnflag = 'R'").select("l_linenumber", "l_orderkey", F.lit("rio").alias("filename"), "l_tax")
    return typed.union_frames(drive, rio)


def wall_clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", _micros().alias("us"))
    return events.select("event_id", F.date_format(wall_clock(F.col("us")), "yyyy-MM-dd HH:mm:ss").alias("at"), F.round(seconds(F.col("us")), 3).alias("seconds"))


def _map(spark: SparkSession, subsystem: str, metrics: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(e, subsystem, None, None, "LEAD MOTOR", m) for e, m in metrics.items()], schemas.DEVICE_MAP)


def system_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole system import; a purchase states the match."""
    kind = F.col("event_type")
    signal, info = kind.isin("signup", "error"), kind == "purchase"
    at = _micros()
    records = _table(spark, sf_dir, "events").select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.floor(at / F.lit(604_800_000_000)).cast("string")).alias("filename"),
        F.col("event_id").cast("long").alias("seq"),
        F.when(signal, "DS:enabled").when(info, "NT:/FMSInfo/MatchNumber").otherwise(F.concat(F.lit("NT:R/"), kind)).alias("entry"),
        F.when(signal, "boolean").when(info, "int64").otherwise("double").alias("data_type"),
        F.when(kind == "signup", "True").when(kind == "error", "False").when(info, (F.col("event_id") % 90).cast("string")).otherwise(F.col("value").cast("string")).alias("value"),
        at.alias("timestamp"),
    )
    prefixes = routing.Prefixes("MetaData", "NT:R/", "NT:/P/", "NT:/FMSInfo/", ("NT:/pv/",), ("NT:/pv/",))
    tables = pipelines.ingest_system(records, _map(spark, "ELEVATOR", {"click": "VOLTAGE", "view": "POSITION"}), spark.createDataFrame([], schemas.VISION_MAP), prefixes, "2025")
    stats = [f"{s}_{m}" for m in ("voltage", "position") for s in ("avg", "min", "max", "stddev")]
    return _rounded(tables["device_stats"].select("filename", "event_year", "match_id", "subsystem", "component", *stats))


def device_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the import of device logs, each with its own map."""
    name = F.concat(F.when(F.col("user_id") % 3 == 0, "rio_").otherwise("drive_"), F.col("user_id").cast("string"))
    records = _table(spark, sf_dir, "events").select(name.alias("filename"), F.col("event_id").cast("long").alias("seq"), F.col("event_type").alias("entry"), F.lit("double").alias("data_type"), F.col("value").cast("string").alias("value"), _micros().alias("timestamp"))
    tables = pipelines.ingest_devices(records, _map(spark, "DRIVE", {"click": "VOLTAGE", "error": "CURRENT"}), _map(spark, "RIO", {"click": "VELOCITY", "view": "POSITION"}))
    return _rounded(tables["device_stats"].drop(*schemas.MATCH_KEYS, "assembly", "subassembly"))


def metadata_of_match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("match_id"), F.col("c_mktsegment").alias("event"))
    return pipelines.match_files(_files(spark, sf_dir), metadata)


def _session_records(spark: SparkSession, sf_dir: str, session: Column) -> DataFrame:
    """LONG records of events: signup and error switch the active period, a purchase
    states the match, the others are metrics."""
    kind = F.col("event_type")
    signal, info = kind.isin("signup", "error"), kind == "purchase"
    return _table(spark, sf_dir, "events").select(
        session.alias("filename"),
        F.col("event_id").cast("long").alias("seq"),
        F.when(signal, "DS:enabled").when(info, "NT:/FMSInfo/MatchNumber").otherwise(F.concat(F.lit("NT:R/"), kind)).alias("entry"),
        F.when(signal, "boolean").when(info, "int64").otherwise("double").alias("data_type"),
        F.when(kind == "signup", "True").when(kind == "error", "False").when(info, (F.col("event_id") % 90).cast("string")).otherwise(F.col("value").cast("string")).alias("value"),
        _micros().alias("timestamp"),
    )


SEASON = routing.Prefixes("MetaData", "NT:R/", "NT:/P/", "NT:/FMSInfo/", ("NT:/pv/",), ("NT:/pv/",))
_SHOWN = [f"{s}_{m}" for m in ("voltage", "position") for s in ("avg", "min", "max", "stddev")]


def staged_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of twenty logs, staged as CSV, read back in their order and imported."""
    path = shared_folder(spark, "staged")
    staged.write_staged(_session_records(spark, sf_dir, F.concat(F.lit("log "), (F.col("user_id") % 20).cast("string"))), path)
    tables = pipelines.ingest_system(staged.read_staged(spark, path), _map(spark, "ELEVATOR", {"click": "VOLTAGE", "view": "POSITION"}), spark.createDataFrame([], schemas.VISION_MAP), SEASON, "2025")
    return _rounded(tables["device_stats"].select("filename", "event_year", "match_id", "subsystem", "component", *_SHOWN))


def match_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three logs each, stored and imported; the rio logs come late and
    their matches are done anew."""
    root, role = shared_folder(spark, "matches"), F.col("user_id") % 3
    match = F.expr("user_id div 3").cast("string")
    name = F.when(role == 0, F.concat(F.lit("log_"), match, F.lit(".wpilog"))).otherwise(F.concat(F.when(role == 1, "drive_").otherwise("rio_"), match, F.lit("_1.hoot")))
    records = _session_records(spark, sf_dir, name)
    # a device log has the entries of its map, which have no prefix
    records = records.withColumn("entry", F.when(F.col("filename").startswith("log_"), F.col("entry")).otherwise(without_prefix(F.col("entry"), "NT:R/")))
    listed = _table(spark, sf_dir, "events").select(name.alias("filename")).distinct()
    files = file_sets.classify_files(listed.select(F.concat(F.lit("/in/"), "filename").alias("path"), "filename", F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("bigint").alias("modified")))
    drive, rio = _map(spark, "DRIVE", {"click": "VOLTAGE", "view": "POSITION"}), _map(spark, "RIO", {"click": "POSITION", "view": "VOLTAGE"})
    kept = imports.kept_in(root)
    files = kept(files, "listed")
    for new in (files.where("kind <> 'rio'"), files.where("kind = 'rio'")):
        imports.stored(root, "records").replace(records.join(new.select("filename"), "filename", "left_semi"), new.select("filename"))
        imports.stored(root, "files").replace(new, new.select("filename"))
        ready, _ = imports.ready_sets(imports.read_table(spark, root, "files"), new, ("system",))
        ready = kept(ready, "ready")
        imports.redo_matches(spark, root, ready, imports.match_tables(ready, drive, rio, spark.createDataFrame([], schemas.VISION_MAP), SEASON, "2025", root=root))
    return _rounded(imports.read_table(spark, root, "device_stats").select("filename", "event_year", "match_id", "subsystem", "component", *_SHOWN))


def import_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of new files whose names and contents meet those in the ledger."""
    name = F.concat(F.lit("f"), (F.col("doc_id") % 200).cast("string")).alias("filename")
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), name, F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), (F.col("doc_id") % 50).alias("modified"), (F.col("doc_id") % 7 != 0).alias("is_log"), (F.col("doc_id") % 3 != 0).alias("success"))
    done = ledger.newest_versions(files.where("doc_id % 4 = 0").select("filename", "file_hash", "success", "modified"))
    found = choose(files.where("doc_id % 4 <> 0").drop("doc_id", "success"), done)
    return typed.union_frames(*[f.select("path", F.lit(outcome).alias("outcome")) for outcome, f in found.items()])


def ledger_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unsuccessful attempt at each document, then a success, entered by the clock."""
    files = _hashed(spark, sf_dir).select("filename", "file_hash")
    rows = ledger.attempt(files, 1, False, "started").unionByName(ledger.attempt(files, 2, True, "imported"))
    age = F.unix_timestamp() - F.col("import_timestamp")
    return ledger.latest(rows, ["filename"], ["attempt_id"]).select("filename", "file_hash", "success", "attempt_id", "outcome", ((age >= 0) & (age < 3600) & (F.col("import_timestamp") == F.col("last_attempt_timestamp"))).alias("is_now"))


def decoded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of several declared types as text; those that do not fit are left out."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    turn = F.col("event_id") % 5
    flags = F.unhex(F.concat(two(F.col("event_id") % 2), two(F.col("event_id") % 3), two(F.col("event_id") % 7)))
    declared = F.when(turn == 0, "boolean[]").when(turn == 1, "msgpack").when(turn == 2, "string").when(turn == 3, "boolean").otherwise("int64[]")
    payload = F.when(turn == 0, flags).when(turn == 1, F.encode("event_type", "UTF-8")).when(turn == 2, F.encode(F.concat("event_type", F.lit("\r\n"), "event_type"), "UTF-8")).when(turn == 3, F.unhex(F.when(F.col("event_id") % 2 == 0, "01").otherwise("0100")))
    # eight bytes for each number, the lowest first
    payload = payload.otherwise(F.unhex(F.concat(two(F.col("event_id") % 200), F.lit("0" * 14), F.lit("f" * 16))))
    records = _table(spark, sf_dir, "events").select(F.lit("f").alias("filename"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), declared.alias("type"), payload.alias("payload"), _micros().alias("timestamp"))
    return decode_values(records).select("seq", "entry", "data_type", "value", F.array_join("items", "|").alias("items"))


def unparsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a numeric type whose value is no decimal number."""
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.floor("value").cast("string"), F.lit("d"))).when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise("nan")
    kind = F.when(F.col("event_id") % 2 == 0, "double").otherwise("string")
    return typed.unparsed(_table(spark, sf_dir, "events").select("event_id", kind.alias("data_type"), value.alias("value")))


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``summary_upsert`` in a stored table, whose second run is done twice."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr("nullif(o_custkey % 9, 0)").alias("part"), "o_totalprice")
    total = lambda f: f.groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    first, second = total(orders.where("o_orderkey % 2 = 0")), total(orders.where("o_orderkey % 4 = 1 and coalesce(part, 0) in (0, 1, 2)"))
    table = StoredTable(shared_folder(spark, "summary"), first.schema, ("o_orderpriority", "part"), 8)
    for rows in (first, second, second):
        table.replace(rows)
    return table.read(spark)


def stored_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flush_file`` in a stored table: the rows of some keys go, others stay."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    table = StoredTable(shared_folder(spark, "lines"), lines.schema, ("l_suppkey",), 16)
    table.replace(lines)
    table.replace(lines.limit(0), _table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("l_suppkey")))
    return table.read(spark)


QUERIES = {
    "staged_import": staged_import,
    "match_import": match_import,
    "import_choice": import_choice,
    "ledger_attempts": ledger_attempts,
    "decoded_values": decoded_values,
    "unparsed_values": unparsed_values,
    "stored_upsert": stored_upsert,
    "stored_flush": stored_flush,
    "device_stats": device_stats,
    "device_telemetry": device_telemetry,
    "vision_telemetry": vision_telemetry,
    "vision_stats": vision_stats,
    "match_period": match_period,
    "trim_by_period": trim_by_period,
    "trim_open_end_keep": trim_open_end_keep,
    "file_clock": file_clock,
    "entry_map_join": entry_map_join,
    "map_lint": map_lint,
    "route_prefix": route_prefix,
    "strip_prefixes": strip_prefixes,
    "typed_values": typed_values,
    "match_keys": match_keys,
    "metadata_pivot": metadata_pivot,
    "resolve_entries": resolve,
    "skip_imported": skip_imported,
    "imported_as": imported_as,
    "ledger_latest": ledger_latest,
    "summary_upsert": summary_upsert,
    "flush_file": flush_file,
    "electrical_summary": electrical_summary,
    "file_sets": match_file_sets,
    "orphan_files": orphan_files,
    "pipelines_union": pipelines_union,
    "wall_clock": wall_clock_times,
    "system_import": system_import,
    "device_import": device_import,
    "match_files": metadata_of_match_files,
}

_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in METRIC_OF.items()) + " END"
_STATS = ", ".join(
    f"round(avg({'abs(v)' if name == 'velocity' else 'v'}) FILTER (metric = '{m}'), 6) AS avg_{name}, round(min(v) FILTER (metric = '{m}'), 6) AS min_{name}, "
    f"round(max(v) FILTER (metric = '{m}'), 6) AS max_{name}, round(stddev_samp({'abs(v)' if name == 'velocity' else 'v'}) FILTER (metric = '{m}'), 6) AS stddev_{name}"
    for name, m in (("voltage", "VOLTAGE"), ("current", "CURRENT"), ("velocity", "VELOCITY"), ("position", "POSITION"), ("temperature", "TEMP"))
)
_SIGNALS = """WITH s AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 604800000000.0) AS BIGINT) AS week, event_type, epoch_us(ts) AS timestamp FROM events),
 e AS (SELECT user_id, week, min(timestamp) AS enable_ts FROM s WHERE event_type = 'signup' GROUP BY ALL),
 p AS (SELECT e.user_id, e.week, e.enable_ts, max(s.timestamp) AS terminated_ts FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.week = e.week AND s.event_type = 'error' AND s.timestamp > e.enable_ts GROUP BY ALL) """
_TRIM = _SIGNALS + "SELECT s.event_id, s.user_id, s.week, s.timestamp, s.timestamp - p.enable_ts AS match_time FROM s JOIN p ON s.user_id = p.user_id AND s.week = p.week WHERE s.timestamp > p.enable_ts AND "
_SIGHTS = """WITH v AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, nullif(user_id % 5, 0) AS camera,
 CASE event_type WHEN 'click' THEN 'HAS_TARGET' WHEN 'view' THEN 'LATENCY' WHEN 'error' THEN 'PITCH' END AS metric,
 CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'True' ELSE 'False' END END AS b, CASE WHEN event_type = 'view' THEN value END AS n FROM events) """
_HASHED = "WITH f AS (SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS filename, sha256(coalesce(text, '')) AS file_hash, doc_id % 3 <> 0 AS success FROM documents) "
_FILES = """WITH f AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN '/in/log_' || o_custkey || '.wpilog' WHEN 1 THEN '/in/drive_' || o_custkey || '_0301.hoot'
 WHEN 2 THEN '/in/rio_' || o_custkey || '_0301.hoot' ELSE '/in/notes_' || o_custkey || '.txt' END AS path,
 CASE o_orderkey % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'drive' WHEN 2 THEN 'rio' END AS kind, CAST(o_custkey AS VARCHAR) AS match_id FROM orders) """


def _wide_sql(source: str, keys: list[str], columns: dict[str, tuple[str, str]]) -> str:
    """Spine and one null-safe left join for each column."""
    joins = "".join(f" LEFT JOIN (SELECT * FROM v WHERE metric = '{m}') {c} ON " + " AND ".join(f"{c}.{k} IS NOT DISTINCT FROM s.{k}" for k in keys) for c, (m, _) in columns.items())
    values = ", ".join(f"{c}.{x} AS {c}" for c, (_, x) in columns.items())
    return f"{source} SELECT {', '.join('s.' + k for k in keys)}, {values} FROM (SELECT DISTINCT {', '.join(keys)} FROM v WHERE metric IS NOT NULL) s{joins}"


_TWO_STATS = ", ".join(f"round({f}(v) FILTER (metric = '{m.upper()}'), 6) AS {a}_{m}" for m in ("voltage", "position") for a, f in (("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev", "stddev_samp")))

ORACLE_SQL = {
    "staged_import": f"""WITH s AS (SELECT event_id, user_id % 20 AS f, event_type, value, epoch_us(ts) AS t_us FROM events),
 e AS (SELECT f, min(t_us) AS enable_ts FROM s WHERE event_type = 'signup' GROUP BY f), p AS (SELECT e.f, enable_ts, max(t_us) AS terminated_ts FROM e JOIN s ON s.f = e.f AND event_type = 'error' AND t_us > enable_ts GROUP BY ALL),
 i AS (SELECT f, CAST(arg_max(event_id % 90, event_id) AS VARCHAR) AS match_id FROM s WHERE event_type = 'purchase' GROUP BY f),
 t AS (SELECT s.f, CASE event_type WHEN 'click' THEN 'VOLTAGE' ELSE 'POSITION' END AS metric, value AS v FROM s JOIN p ON p.f = s.f WHERE event_type IN ('click', 'view') AND t_us > enable_ts AND t_us < terminated_ts)
 SELECT 'log ' || t.f AS filename, '2025' AS event_year, i.match_id, 'ELEVATOR' AS subsystem, 'LEAD MOTOR' AS component, {_TWO_STATS} FROM t LEFT JOIN i ON i.f = t.f GROUP BY ALL""",
    "match_import": f"""WITH s AS (SELECT event_id, user_id // 3 AS m, user_id % 3 AS role, event_type, value, epoch_us(ts) AS t_us FROM events),
 e AS (SELECT m, min(t_us) AS enable_ts FROM s WHERE role = 0 AND event_type = 'signup' GROUP BY m), p AS (SELECT e.m, enable_ts, max(t_us) AS terminated_ts FROM e JOIN s ON s.m = e.m AND role = 0 AND event_type = 'error' AND t_us > enable_ts GROUP BY ALL),
 i AS (SELECT m, CAST(arg_max(event_id % 90, event_id) AS VARCHAR) AS match_id FROM s WHERE role = 0 AND event_type = 'purchase' GROUP BY m),
 t AS (SELECT s.m, role, CASE WHEN (role = 1) = (event_type = 'click') THEN 'VOLTAGE' ELSE 'POSITION' END AS metric, value AS v FROM s JOIN p ON p.m = s.m WHERE role > 0 AND event_type IN ('click', 'view') AND t_us > enable_ts AND t_us < terminated_ts)
 SELECT CASE role WHEN 1 THEN 'drive_' ELSE 'rio_' END || t.m || '_1.hoot' AS filename, '2025' AS event_year, i.match_id, CASE role WHEN 1 THEN 'DRIVE' ELSE 'RIO' END AS subsystem, 'LEAD MOTOR' AS component, {_TWO_STATS} FROM t LEFT JOIN i ON i.m = t.m GROUP BY t.m, role, i.match_id""",
    "import_choice": """WITH d AS (SELECT doc_id, 'p' || doc_id AS path, 'f' || (doc_id % 200) AS filename, sha256(coalesce(text, '')) AS file_hash, doc_id % 50 AS modified, doc_id % 7 <> 0 AS is_log, doc_id % 3 <> 0 AS success FROM documents),
 l AS (SELECT * FROM d WHERE doc_id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY filename ORDER BY modified DESC, file_hash DESC, success DESC) = 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY modified DESC, file_hash DESC, path DESC) AS r FROM d WHERE doc_id % 4 <> 0 AND is_log AND file_hash NOT IN (SELECT file_hash FROM l WHERE success)),
 n AS (SELECT *, EXISTS (SELECT 1 FROM l WHERE l.success AND l.filename = f.filename AND l.file_hash <> f.file_hash AND (l.modified > f.modified OR l.modified = f.modified AND l.file_hash > f.file_hash)) AS late FROM f WHERE r = 1)
 SELECT path, 'not a log' AS outcome FROM d WHERE doc_id % 4 <> 0 AND NOT is_log UNION ALL SELECT path, 'superseded' FROM f WHERE r > 1 UNION ALL SELECT path, 'superseded' FROM n WHERE late
 UNION ALL SELECT arg_min(path, filename), 'chosen' FROM n WHERE NOT late GROUP BY file_hash""",
    "ledger_attempts": _HASHED + "SELECT filename, file_hash, true AS success, CAST(2 AS BIGINT) AS attempt_id, 'imported' AS outcome, true AS is_now FROM f",
    "decoded_values": """WITH e AS (SELECT event_id AS seq, event_type AS entry, event_id % 5 AS turn, event_id % 200 AS low, [event_id % 2 <> 0, event_id % 3 <> 0, event_id % 7 <> 0] AS flags FROM events)
 SELECT seq, entry, ['boolean[]', 'msgpack', 'string', 'boolean', 'int64[]'][turn + 1] AS data_type, CASE turn WHEN 0 THEN '[' || array_to_string(flags, ', ') || ']' WHEN 1 THEN lower(hex(encode(entry))) WHEN 2 THEN entry || '  ' || entry WHEN 3 THEN 'True' ELSE '[' || low || ', -1]' END AS value,
 CASE turn WHEN 0 THEN array_to_string(list_transform(flags, lambda x: CASE WHEN x THEN 'True' ELSE 'False' END), '|') WHEN 4 THEN low || '|-1' END AS items FROM e WHERE turn <> 3 OR seq % 2 = 0""",
    "unparsed_values": "SELECT event_id, 'double' AS data_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'd' AS value FROM events WHERE event_id % 6 = 0",
    "stored_upsert": """WITH o AS (SELECT *, nullif(o_custkey % 9, 0) AS part FROM orders), a AS (SELECT o_orderpriority, part, count(*) AS n, max(o_totalprice) AS top FROM o WHERE o_orderkey % 2 = 0 GROUP BY ALL),
 b AS (SELECT o_orderpriority, part, count(*) AS n, max(o_totalprice) AS top FROM o WHERE o_orderkey % 4 = 1 AND o_custkey % 9 IN (0, 1, 2) GROUP BY ALL)
 SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND b.part IS NOT DISTINCT FROM a.part)""",
    "stored_flush": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)",
    "device_stats": f"SELECT user_id, {_STATS} FROM (SELECT user_id, {_CASE} AS metric, value - CASE WHEN event_type = 'purchase' THEN 50 ELSE 0 END AS v FROM events) WHERE metric IS NOT NULL GROUP BY user_id",
    "device_telemetry": _wide_sql(
        f"WITH v AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, nullif(user_id % 7, 0) AS component, {_CASE} AS metric, value AS n FROM events)",
        ["user_id", "day", "component"],
        {"voltage": ("VOLTAGE", "n"), "current": ("CURRENT", "n"), "velocity": ("VELOCITY", "n"), "position": ("POSITION", "n"), "temperature": ("TEMP", "n")},
    ),
    "vision_telemetry": _wide_sql(_SIGHTS, ["user_id", "day", "camera"], {"has_target": ("HAS_TARGET", "b"), "latency": ("LATENCY", "n")}),
    "vision_stats": _SIGHTS + "SELECT day, camera, round(avg(n), 6) AS avg_latency, round(min(n), 6) AS min_latency, round(max(n), 6) AS max_latency, round(stddev_samp(n), 6) AS stddev_latency FROM v WHERE metric = 'LATENCY' AND camera IS NOT NULL GROUP BY day, camera",
    "match_period": _SIGNALS + "SELECT * FROM p",
    "trim_by_period": _TRIM + "s.timestamp < p.terminated_ts",
    "trim_open_end_keep": _TRIM + "(s.timestamp < p.terminated_ts OR p.terminated_ts IS NULL)",
    "file_clock": "SELECT event_id, user_id, epoch_us(ts) AS timestamp, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS match_time FROM events",
    "entry_map_join": "SELECT l_partkey AS entry, l_orderkey, l_linenumber, l_quantity, p_brand AS component, p_type AS metric FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey",
    "map_lint": "SELECT p_partkey AS entry, 'unmatched' AS problem FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT p_partkey, 'no metric' FROM part WHERE NOT p_size <= 25",
    "route_prefix": """WITH e AS (SELECT event_id, 'NT:' || event_type || '/' || user_id AS entry FROM events)
 SELECT event_id, entry, 'metadata' AS route FROM e WHERE starts_with(entry, 'NT:signup') UNION ALL SELECT event_id, entry, 'match_info' FROM e WHERE starts_with(entry, 'NT:error')
 UNION ALL SELECT event_id, replace(entry, 'NT:click/', ''), 'metrics' FROM e WHERE starts_with(entry, 'NT:click/') UNION ALL SELECT event_id, replace(entry, 'NT:view/', ''), 'vision' FROM e WHERE starts_with(entry, 'NT:view/')
 UNION ALL SELECT event_id, entry, 'preferences' FROM e WHERE starts_with(entry, 'NT:purchase')""",
    "strip_prefixes": "SELECT event_id, replace(replace(replace('NT:' || event_type || '/' || user_id, 'NT:', ''), 'view/', ''), '1', '') AS entry FROM events",
    "typed_values": """SELECT event_id, data_type, value, CASE WHEN data_type = 'boolean' THEN value END AS boolean_value,
 CASE WHEN data_type IN ('int64', 'double') AND value <> 'nan' THEN try_cast(value AS DOUBLE) END AS numeric_value FROM (SELECT event_id, ['boolean', 'int64', 'double', 'string'][event_id % 4 + 1] AS data_type,
 CASE WHEN event_id % 4 = 0 THEN CASE WHEN value > 50 THEN 'True' ELSE 'False' END WHEN event_id % 4 = 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN event_id % 12 = 2 THEN 'nan'
 WHEN event_id % 12 = 6 THEN 'no number' WHEN event_id % 4 = 2 THEN CAST(CAST(floor(value * 2) AS BIGINT) AS VARCHAR) ELSE props END AS value FROM events)""",
    "match_keys": "SELECT CAST(l_orderkey AS VARCHAR) AS filename, l_linenumber, l_quantity, o_orderpriority AS event, CAST(o_custkey AS VARCHAR) AS match_id, o_orderstatus AS match_type, CASE WHEN o_orderkey IS NOT NULL THEN '0' END AS replay_num, '2025' AS event_year FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "metadata_pivot": "WITH p AS (SELECT user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) END AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events WHERE event_id % 11 <> 0) SELECT u.user_id, "
    + ", ".join(f"max(v) FILTER (event_type = '{k}' AND r = 1) AS last_{k}" for k in METRIC_OF)
    + " FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON p.user_id = u.user_id GROUP BY u.user_id",
    "resolve_entries": """WITH w AS (SELECT user_id, event_id AS seq, event_type, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events)
 SELECT w.user_id, w.seq, e.props AS name, e.event_type AS type FROM w JOIN events e ON e.event_id = w.c WHERE e.event_type = 'signup' AND w.event_type NOT IN ('signup', 'error')""",
    "skip_imported": _HASHED + "SELECT doc_id, file_hash FROM f WHERE doc_id % 2 = 1 AND file_hash NOT IN (SELECT file_hash FROM f WHERE doc_id % 2 = 0 AND success)",
    "imported_as": _HASHED + "SELECT a.doc_id, min(b.filename) AS imported_as FROM f a JOIN f b ON a.file_hash = b.file_hash WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 AND b.success GROUP BY a.doc_id",
    "ledger_latest": "SELECT o_custkey, epoch_us(o_orderdate) AS placed, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "summary_upsert": """WITH o AS (SELECT *, nullif(o_custkey % 9, 0) AS part FROM orders), a AS (SELECT o_orderpriority, part, count(*) AS n, max(o_totalprice) AS top FROM o WHERE o_orderkey % 2 = 0 GROUP BY ALL),
 b AS (SELECT o_orderpriority, part, count(*) AS n, max(o_totalprice) AS top FROM o WHERE o_orderkey % 4 = 1 AND o_custkey % 9 IN (0, 1, 2) GROUP BY ALL)
 SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND b.part IS NOT DISTINCT FROM a.part)""",
    "flush_file": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)",
    "electrical_summary": """WITH m AS (SELECT l_returnflag, l_linestatus, ['CURRENT', 'TEMP', 'VOLTAGE', 'POSITION'][l_linenumber % 4 + 1] AS metric, CASE WHEN l_suppkey % 10 = 0 THEN 'int64' ELSE 'double' END AS data_type,
 CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_discount END AS v, abs(l_quantity - 25) AS n FROM lineitem)
 SELECT l_returnflag, l_linestatus, metric, max(n) AS max_abs_value, min(n) AS min_abs_value, round(avg(n), 6) AS avg_abs_value FROM m WHERE data_type = 'double' AND abs(v) > 0.05 AND metric <> 'POSITION' GROUP BY ALL""",
    "file_sets": _FILES + "SELECT match_id, " + ", ".join(f"coalesce(string_agg(path, '|' ORDER BY path) FILTER (kind = '{k}'), '') AS {k}" for k in ("system", "drive", "rio")) + " FROM f WHERE kind IS NOT NULL GROUP BY match_id HAVING count(*) FILTER (kind = 'system') > 0",
    "orphan_files": _FILES + "SELECT path, kind, match_id FROM f WHERE kind IN ('drive', 'rio') AND match_id NOT IN (SELECT match_id FROM f WHERE kind = 'system')",
    "pipelines_union": "SELECT l_orderkey, l_linenumber, 'drive' AS filename, l_quantity, NULL::DOUBLE AS l_tax FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber, 'rio', NULL, l_tax FROM lineitem WHERE l_returnflag = 'R'",
    "wall_clock": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(epoch_us(ts) / 1e6, 3) AS seconds FROM events",
    "system_import": _SIGNALS + f""", i AS (SELECT user_id, week, CAST(arg_max(event_id % 90, event_id) AS VARCHAR) AS match_id FROM s WHERE event_type = 'purchase' GROUP BY ALL),
 t AS (SELECT s.user_id, s.week, CASE s.event_type WHEN 'click' THEN 'VOLTAGE' ELSE 'POSITION' END AS metric, x.value AS v FROM s JOIN events x ON x.event_id = s.event_id JOIN p ON p.user_id = s.user_id AND p.week = s.week
 WHERE s.event_type IN ('click', 'view') AND s.timestamp > p.enable_ts AND s.timestamp < p.terminated_ts)
 SELECT t.user_id || '_' || t.week AS filename, '2025' AS event_year, i.match_id, 'ELEVATOR' AS subsystem, 'LEAD MOTOR' AS component, {_TWO_STATS}
 FROM t LEFT JOIN i ON i.user_id = t.user_id AND i.week = t.week GROUP BY ALL""",
    "device_import": f"""WITH t AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'rio_' ELSE 'drive_' END || user_id AS filename, CASE WHEN user_id % 3 = 0 THEN 'RIO' ELSE 'DRIVE' END AS subsystem, value AS v,
 CASE WHEN user_id % 3 = 0 THEN CASE event_type WHEN 'click' THEN 'VELOCITY' WHEN 'view' THEN 'POSITION' END ELSE CASE event_type WHEN 'click' THEN 'VOLTAGE' WHEN 'error' THEN 'CURRENT' END END AS metric FROM events)
 SELECT filename, subsystem, 'LEAD MOTOR' AS component, {_STATS} FROM t WHERE metric IS NOT NULL GROUP BY ALL""",
    "match_files": _FILES + """SELECT f.match_id, f.path, regexp_extract(f.path, '[^/]+$') AS filename, c.c_mktsegment AS event FROM f LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = f.match_id
 WHERE f.kind IS NOT NULL AND f.match_id IN (SELECT match_id FROM f WHERE kind = 'system')""",
}
