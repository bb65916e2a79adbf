import hashlib
import io
import random
import struct

import pytest

from loggrove.sources.container import ByteWindow, NotALog, decode_payload, decode_values, entry_intervals, file_facts, list_files, read_log_files, resolve_entries, resolve_entries_window, stream_records, walk
from tests.logs import finish, header, record, start, text


def test_walk_reads_every_width_and_stops_at_a_cut_record():
    log = header("extra") + record(1, 5, b"a") + record(300, 70_000, b"bc", id_width=3) + record(2**31, 2**63 + 1, b"", id_width=4, time_width=8) + record(7, 9, b"lost")[:-2]
    rows = list(walk(log))
    assert [(r[1], r[2], r[7]) for r in rows] == [(1, 5, b"a"), (300, 70_000, b"bc"), (2**31, 2**63 + 1 - 2**64, b"")]
    assert [r[0] for r in rows] == [0, 1, 2]


@pytest.mark.parametrize("content", [b"", b"WPILOG", b"NOTLOG" + b"\0" * 20, header(version=0x00FF)])
def test_other_content_is_no_log(content):
    with pytest.raises(NotALog):
        list(walk(content))


def test_control_records_that_do_not_fit_are_marked():
    rows = list(walk(header() + record(0, 1, b"\0\1") + record(0, 1, b"\7" + b"\0" * 8) + record(0, 1, b"\2" + struct.pack("<I", 4) + text("m")) + record(0, 1, b"\0" + struct.pack("<I", 4) + struct.pack("<I", 99) + b"x" * 12)))
    assert [r[3] for r in rows] == ["invalid", "unknown_control", "set_metadata", "invalid"]


@pytest.mark.parametrize(
    "kind, payload, value",
    [
        ("boolean", b"\2", "True"),
        ("boolean", b"", None),
        ("int64", struct.pack("<q", -5), "-5"),
        ("int64", b"\0", None),
        ("double", struct.pack("<d", 12.5), "12.5"),
        ("double", struct.pack("<d", float("nan")), "nan"),
        ("float", struct.pack("<f", 1.5), None),
        ("json", b"{}", "{}"),
        ("msgpack", b"\x81", "81"),
        ("boolean[]", b"\1\0", "[true, false]"),
        ("int64[]", struct.pack("<2q", 1, -2), "[1, -2]"),
        ("double[]", struct.pack("<2d", 1, 2.5), "[1.0, 2.5]"),
        ("float[]", b"\0" * 5, None),
        ("string[]", struct.pack("<I", 2) + text("p") + text("q"), '["p", "q"]'),
        ("string[]", struct.pack("<I", 2**31) + text("p"), None),
        ("raw", b"x", None),
    ],
)
def test_decode(kind, payload, value):
    found = decode_payload(kind, payload)
    assert (found and found[0]) == value


def test_files_are_resolved_and_decoded_each_on_its_own(spark, tmp_path):
    one = header() + record(3, 1, b"\1") + start(3, "a", "boolean") + record(3, 2, b"\1") + start(3, "b", "string") + record(3, 3, b"x,\r\ny|") + finish(3) + record(3, 4, b"z")
    two = header() + start(3, "c", "int64") + record(3, 5, struct.pack("<q", 7)) + record(3, 6, b"short") + start(4, "systemTime", "int64") + record(4, 7, struct.pack("<q", 7))
    (tmp_path / "one.wpilog").write_bytes(one)
    (tmp_path / "two.wpilog").write_bytes(two)
    (tmp_path / "bad.wpilog").write_bytes(b"no log at all")
    records = read_log_files(spark, str(tmp_path / "*.wpilog"))
    rows = decode_values(resolve_entries(records, ["filename"])).select("filename", "entry", "data_type", "value", "timestamp").collect()
    assert sorted(map(tuple, rows)) == [("one.wpilog", "a", "boolean", "True", 2), ("one.wpilog", "b", "string", "x,  y|", 3), ("two.wpilog", "c", "int64", "7", 5)]


class Made:
    """A long file that is made as it is read."""

    def __init__(self, head, piece, times):
        self.head, self.piece, self.length, self.at, self.most = head, piece, len(head) + len(piece) * times, 0, 0

    def read(self, n):
        self.most = max(self.most, n)
        n = min(n, self.length - self.at)
        out, at = b"", self.at
        if at < len(self.head):
            out = self.head[at : at + n]
        if len(out) < n:
            place = (at + len(out) - len(self.head)) % len(self.piece)
            times = (n - len(out)) // len(self.piece) + 2
            out += (self.piece * times)[place : place + n - len(out)]
        self.at += n
        return out


def test_a_long_file_is_read_in_blocks():
    piece = record(1, 5, bytes(100_000))
    made = Made(header() + start(1, "a", "raw"), piece, 4000)
    window, facts, most, n = ByteWindow(made, made.length, hashlib.sha256()), {}, 0, 0
    for r in walk(window, facts):
        most, n = max(most, len(window.data)), n + 1
    assert made.length > 4e8 and (n, facts) == (4001, {"truncated": False})
    assert most <= (1 << 20) + len(piece) and made.most <= 1 << 20


def test_a_length_beyond_the_end_is_not_read():
    damaged = bytes([0 | 3 << 2 | 0 << 4]) + b"\x01" + struct.pack("<I", 2**32 - 1) + b"\x05" + bytes(50)
    content = header() + record(1, 1, b"x") + damaged
    window, facts = ByteWindow(io.BytesIO(content), len(content), block=16), {}
    assert [r[7] for r in walk(window, facts)] == [b"x"] and facts == {"truncated": True}
    assert window.left > 0  # what the damaged record claims was never asked for
    cut = header("extra")[:-2]
    assert list(walk(cut, facts)) == [] and facts == {"truncated": True}


def test_facts_and_records_come_from_one_pass(spark, tmp_path):
    files = {"a b.wpilog": header() + start(1, "n", "int64") + record(1, 2, bytes(8)) + record(0, 3, b"\0\1"), "cut.wpilog": header() + record(1, 2, bytes(8))[:-1], "no.wpilog": b"other", "empty.wpilog": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in files], "path string")
    got = {r.filename: (r.file_hash, r.length, r.is_log, r.records, r.invalid, r.truncated) for r in file_facts(paths).collect()}
    digest = lambda n: hashlib.sha256(files[n]).hexdigest()
    assert got["a b.wpilog"] == (digest("a b.wpilog"), len(files["a b.wpilog"]), True, 3, 1, False)
    assert got["cut.wpilog"] == (digest("cut.wpilog"), len(files["cut.wpilog"]), True, 0, 0, True)
    assert [got[n] for n in ("no.wpilog", "empty.wpilog")] == [(digest(n), len(files[n]), False, 0, 0, False) for n in ("no.wpilog", "empty.wpilog")]
    rows = stream_records(paths, facts=True).collect()
    assert {(r.filename, r.type, r.metadata) for r in rows if r.kind == "file"} == {(f"file:{tmp_path}/{n}", digest(n), s) for n, s in (("a b.wpilog", "log"), ("cut.wpilog", "truncated"), ("no.wpilog", "no log"), ("empty.wpilog", "no log"))}
    assert sorted(r.kind for r in rows if r.kind != "file") == ["data", "invalid", "start"]
    assert [r.kind for r in read_log_files(spark, f"{tmp_path}/a*.wpilog", kinds=("data",)).collect()] == ["data"]
    assert len(list_files(str(tmp_path))) == 4 and list_files(f"file:{tmp_path}/c*") == [f"{tmp_path}/cut.wpilog"]
    with pytest.raises(Exception, match="no container header"):
        read_log_files(spark, f"{tmp_path}/no.wpilog", strict=True).collect()
    with pytest.raises(FileNotFoundError):
        list_files(f"{tmp_path}/missing.wpilog")


def test_intervals_and_window_give_the_same_rows_without_gathering_an_entry(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for f in ("a", "b", None):
        for seq in range(1500):
            # most rows of a file belong to one entry
            entry = 1 if r.random() < 0.8 else r.randint(2, 9)
            kind = r.choices(["data", "start", "finish", "set_metadata", "invalid"], [90, 4, 3, 2, 1])[0]
            rows.append((f, seq, entry, seq, kind, f"n{r.randint(0, 3)}" if kind == "start" else None, "int64" if kind == "start" else None, None, b"x"))
    records = spark.createDataFrame(rows, "filename string, seq long, entry_id long, timestamp long, kind string, name string, type string, metadata string, payload binary")
    columns = ["filename", "seq", "entry_id", "name", "type"]
    wanted = sorted(map(repr, resolve_entries_window(records, ["filename"]).select(columns).collect()))
    found = resolve_entries(records, ["filename"])
    assert sorted(map(repr, found.select(columns).collect())) == wanted and len(wanted) > 1000
    entry_intervals(records, ["filename"]).write.parquet(str(tmp_path / "spans"))
    kept = resolve_entries(records, ["filename"], intervals=spark.read.parquet(str(tmp_path / "spans"))).select(columns)
    assert sorted(map(repr, kept.collect())) == wanted
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, resolve_entries(records, ["filename"]).select(columns).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
