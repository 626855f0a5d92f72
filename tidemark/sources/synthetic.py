"""Synthetic ZIP bytes, well-formed or not, written from the format."""

from __future__ import annotations

import struct
import zlib


def tlv(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def unicode_path(name: bytes, text: str) -> bytes:
    return tlv(0x7075, b"\x01" + struct.pack("<I", zlib.crc32(name)) + text.encode())


def risky() -> bytes:
    """An archive with one entry or two of every kind of finding, for demonstrations."""
    names = ["Notes.txt", "notes.txt", "aux.log", "ends with a dot.", "na\u00efve.md", "nai\u0308ve.md", "/".join(["folder"] * 40) + "/file", "../outside"]
    link = {"name": "link", "data": b"Notes.txt", "attr": 0o120777 << 16}
    return make([*names, link, {"name": "zeros.bin", "data": bytes(1 << 17), "method": 8}])


def make(entries, comment: bytes = b"", count: int | None = None, size: int | None = None) -> bytes:
    """entries: names, or dicts with name and any of data, flags, method, extra, system, attr, crc, declared, offset, local_name, payload."""
    body, central = b"", b""
    for entry in entries:
        e = {"data": b"x", "flags": 0x800, "method": 0, "extra": b"", "system": 3, "attr": 0, **(entry if isinstance(entry, dict) else {"name": entry})}
        name = e["name"] if isinstance(e["name"], bytes) else e["name"].encode()
        deflater = zlib.compressobj(9, zlib.DEFLATED, -15)
        payload = e.get("payload", deflater.compress(e["data"]) + deflater.flush() if e["method"] == 8 else e["data"])
        crc, declared = e.get("crc", zlib.crc32(e["data"])), e.get("declared", len(e["data"]))
        offset = e.get("offset", len(body))
        local_name = e.get("local_name", name)
        body += struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, e["flags"], e["method"], 0, 33, crc, len(payload), declared, len(local_name), 0) + local_name + payload
        central += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", e["system"] << 8 | 20, 20, e["flags"], e["method"], 0, 33, crc, len(payload), declared, len(name), len(e["extra"]), 0, 0, 0, e["attr"], offset) + name + e["extra"]
    n = len(entries) if count is None else count
    return body + central + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, len(central) if size is None else size, len(body), len(comment)) + comment
