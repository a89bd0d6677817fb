"""ZIP archives by their central directory, tolerant of archives that were tampered with."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from dexlake.formats.binary import FormatError, part, u16, u32, u64

# Fixed values of the format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8
BACK_SCAN = 65_557
MOST_OUTPUT = 1 << 30


@dataclass(frozen=True)
class Entry:
    entry_idx: int
    name: str
    method: int
    flags: int
    crc32: int
    compressed_size: int
    uncompressed_size: int
    local_header_offset: int


def _end(data: bytes) -> int:
    """Where the end record is: the last one whose comment reaches exactly to the end, else the last one."""
    low = max(0, len(data) - BACK_SCAN)
    at = loose = data.rfind(END, low)
    while at >= 0:
        if at + 22 <= len(data) and at + 22 + u16(data, at + 20) == len(data):
            return at
        at = data.rfind(END, low, at)
    if loose < 0 or loose + 22 > len(data):
        raise FormatError("no end of central directory")
    return loose


def entries(data: bytes) -> list[Entry]:
    """All records of the central directory, in its order."""
    end = _end(data)
    count, size, at = u16(data, end + 10), u32(data, end + 12), u32(data, end + 16)
    if (count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF) and data[end - 20 : end - 16] == LOCATOR64:
        wide = u64(data, end - 12)
        if data[wide : wide + 4] != END64:
            raise FormatError("no zip64 end record")
        count, size, at = u64(data, wide + 32), u64(data, wide + 40), u64(data, wide + 48)
    found = []
    for i in range(count):
        if data[at : at + 4] != CENTRAL:
            raise FormatError(f"central record {i} is missing")
        flags, method, crc = u16(data, at + 8), u16(data, at + 10), u32(data, at + 16)
        packed, plain = u32(data, at + 20), u32(data, at + 24)
        n, extra, note, local = u16(data, at + 28), u16(data, at + 30), u16(data, at + 32), u32(data, at + 42)
        name = part(data, at + 46, n)
        p, stop = at + 46 + n, at + 46 + n + extra
        while p + 4 <= stop:
            kind, length = u16(data, p), u16(data, p + 2)
            if kind == 1:
                q = p + 4
                values = []
                for v in (plain, packed, local):
                    if v == 0xFFFFFFFF and q + 8 <= p + 4 + length:
                        values.append(u64(data, q))
                        q += 8
                    else:
                        values.append(v)
                plain, packed, local = values
            p += 4 + length
        found.append(Entry(i, name.decode("utf-8", "replace"), method, flags, crc, packed, plain, local))
        at += 46 + n + extra + note
    return found


def _payload(data: bytes, e: Entry) -> bytes:
    if e.flags & 1:
        raise FormatError(f"{e.name} is encrypted")
    if data[e.local_header_offset : e.local_header_offset + 4] != LOCAL:
        raise FormatError(f"{e.name} has no local header")
    start = e.local_header_offset + 30 + u16(data, e.local_header_offset + 26) + u16(data, e.local_header_offset + 28)
    return part(data, start, e.compressed_size)


def read(data: bytes, e: Entry, *, verify: bool = False, most: int = MOST_OUTPUT) -> bytes:
    """Content of an entry: exactly its declared length, or a FormatError."""
    raw = _payload(data, e)
    if e.uncompressed_size > most:
        raise FormatError(f"{e.name} declares {e.uncompressed_size} bytes")
    if e.method == STORED:
        out = raw
    elif e.method == DEFLATED:
        try:
            out = zlib.decompressobj(-15).decompress(raw, e.uncompressed_size + 1)
        except zlib.error as x:
            raise FormatError(f"{e.name}: {x}") from x
    else:
        raise FormatError(f"{e.name} has method {e.method}")
    if len(out) != e.uncompressed_size:
        raise FormatError(f"{e.name} has another length than it declares")
    if verify and zlib.crc32(out) != e.crc32:
        raise FormatError(f"{e.name} has another checksum")
    return out


def prefix(data: bytes, e: Entry, size: int) -> tuple[bytes, bool]:
    """The first bytes of an entry, and whether they are all."""
    raw = _payload(data, e)
    if e.method == STORED:
        out = raw[:size]
    elif e.method == DEFLATED:
        try:
            out = zlib.decompressobj(-15).decompress(raw, size) if size else b""
        except zlib.error as x:
            raise FormatError(f"{e.name}: {x}") from x
    else:
        raise FormatError(f"{e.name} has method {e.method}")
    return out, len(out) >= e.uncompressed_size


def dex_entries(found: list[Entry]) -> list[Entry]:
    """Entries classes.dex, classes2.dex, … of the root: the first record of each name, by number."""
    by_name: dict[str, Entry] = {}
    for e in found:
        if re.fullmatch(r"classes\d*\.dex", e.name):
            by_name.setdefault(e.name, e)
    return sorted(by_name.values(), key=lambda e: (int(e.name[7:-4] or 1), e.entry_idx))


def write(files: list[tuple[str, bytes]] | list[tuple[str, bytes, int]]) -> bytes:
    """A ZIP of (name, content[, method])."""
    out, central = bytearray(), bytearray()
    for name, content, *method in files:
        how = method[0] if method else DEFLATED
        packed = content
        if how == DEFLATED:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = c.compress(content) + c.flush()
        raw = name.encode()
        common = (0).to_bytes(2, "little") + how.to_bytes(2, "little") + bytes(4) + zlib.crc32(content).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + len(content).to_bytes(4, "little") + len(raw).to_bytes(2, "little") + bytes(2)
        central += CENTRAL + b"\x14\0\x14\0" + common + bytes(10) + len(out).to_bytes(4, "little") + raw
        out += LOCAL + b"\x14\0" + common + raw + packed
    at = len(out)
    out += central
    n = len(files).to_bytes(2, "little")
    return bytes(out + END + bytes(4) + n + n + len(central).to_bytes(4, "little") + at.to_bytes(4, "little") + bytes(2))
