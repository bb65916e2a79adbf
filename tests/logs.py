"""Builds log containers for tests."""

from __future__ import annotations

import struct


def _width(n: int) -> int:
    return max(1, (n.bit_length() + 7) // 8)


def text(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


def record(entry: int, timestamp: int, payload: bytes, id_width: int | None = None, time_width: int | None = None) -> bytes:
    a, b, c = id_width or _width(entry), _width(len(payload)), time_width or _width(timestamp)
    return bytes([a - 1 | b - 1 << 2 | c - 1 << 4]) + entry.to_bytes(a, "little") + len(payload).to_bytes(b, "little") + timestamp.to_bytes(c, "little") + payload


def start(entry: int, name: str, kind: str, at: int = 0) -> bytes:
    return record(0, at, b"\0" + struct.pack("<I", entry) + text(name) + text(kind) + text(""))


def finish(entry: int, at: int = 0) -> bytes:
    return record(0, at, b"\1" + struct.pack("<I", entry))


def header(extra: str = "", version: int = 0x0100) -> bytes:
    return b"WPILOG" + struct.pack("<H", version) + text(extra)
