"""Resource tables: packages, types, entries and values."""

from __future__ import annotations

from collections.abc import Iterator

from dexlake.formats.axml import STRING, string_pool, typed, write_pool
from dexlake.formats.binary import FormatError, part, u16, u32

# Fixed values of the format.
TABLE, PACKAGE, TYPE, SPEC, POOL = 0x0002, 0x0200, 0x0201, 0x0202, 0x0001
SPARSE, OFFSET16, COMPLEX, COMPACT = 0x01, 0x02, 0x0001, 0x0008
NO_ENTRY, NO_ENTRY16 = 0xFFFFFFFF, 0xFFFF
MOST_ITEMS = 2 << 20


def config_text(raw: bytes) -> str:
    """A configuration as its best-known qualifiers: language, region, density, version."""
    if len(raw) < 28:
        return "default"
    code = lambda b: b.decode("ascii", "replace").rstrip("\0") if b[0] and b[0] < 0x80 else ""
    words = [code(raw[8:10]), code(raw[10:12]) and "r" + code(raw[10:12])]
    density = u16(raw, 14)
    words += [{120: "ldpi", 160: "mdpi", 240: "hdpi", 320: "xhdpi", 480: "xxhdpi", 640: "xxxhdpi", 0xFFFF: "nodpi"}.get(density, f"{density}dpi") if density else ""]
    words += [f"v{u16(raw, 24)}" if u16(raw, 24) else ""]
    return "-".join(w for w in words if w) or "default"


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    while at + 8 <= end:
        kind, header, size = u16(data, at), u16(data, at + 2), u32(data, at + 4)
        if size < 8 or at + size > end:
            raise FormatError(f"chunk of {size} bytes at {at}")
        yield kind, at, header, size
        at += size


def _value(data: bytes, at: int, strings: list[str]) -> tuple[int, int, str]:
    kind, value = data[at + 3], u32(data, at + 4)
    return kind, value, typed(kind, value, strings)


def resources(data: bytes) -> Iterator[dict]:
    """One row for each value: package, id, type, key, config, value kind, raw value, text, and the items of bags."""
    if u16(data, 0) != TABLE:
        raise FormatError("no resource table")
    strings: list[str] = []
    budget = MOST_ITEMS
    for kind, at, header, size in _chunks(data, u16(data, 2), min(len(data), u32(data, 4))):
        if kind == POOL:
            strings = string_pool(data, at)
        elif kind == PACKAGE:
            number = u32(data, at + 8) & 0xFF
            name = part(data, at + 12, 256).decode("utf-16-le", "replace").split("\0")[0]
            types, keys = (string_pool(data, at + u32(data, at + off)) if u32(data, at + off) else [] for off in (268, 276))
            shift = u32(data, at + 284) if header >= 288 else 0
            for k2, p, h2, _ in _chunks(data, at + header, at + size):
                if k2 != TYPE:
                    continue
                type_id, flags, count, first = data[p + 8], data[p + 9], u32(data, p + 12), p + u32(data, p + 16)
                config = config_text(part(data, p + 20, u32(data, p + 20)))
                if flags & SPARSE:
                    places = [(u16(data, p + h2 + 4 * i), 4 * u16(data, p + h2 + 4 * i + 2)) for i in range(count)]
                elif flags & OFFSET16:
                    places = [(i, 4 * o) for i in range(count) if (o := u16(data, p + h2 + 2 * i)) != NO_ENTRY16]
                else:
                    places = [(i, o) for i in range(count) if (o := u32(data, p + h2 + 4 * i)) != NO_ENTRY]
                for i, off in places:
                    budget -= 1
                    if budget < 0:
                        raise FormatError("too many entries")
                    e = first + off
                    eflags = u16(data, e + 2)
                    compact = bool(eflags & COMPACT)
                    key = u16(data, e) if compact else u32(data, e + 4)
                    row = {"package": name, "res_id": number << 24 | (type_id + shift) << 16 | i, "type": types[type_id - 1] if 0 < type_id <= len(types) else f"type{type_id}", "key": keys[key] if key < len(keys) else f"key{key}", "config": config, "value_kind": None, "value": None, "text": None, "items": []}
                    if compact:
                        row |= {"value_kind": eflags >> 8, "value": u32(data, e + 4), "text": typed(eflags >> 8, u32(data, e + 4), strings)}
                    elif eflags & COMPLEX:
                        for b in range(u32(data, e + 12)):
                            q = e + u16(data, e) + 12 * b
                            row["items"].append({"name": u32(data, q), "text": _value(data, q + 4, strings)[2]})
                    else:
                        row["value_kind"], row["value"], row["text"] = _value(data, e + u16(data, e), strings)
                    yield row


def write(package: str, kind: str, values: list[tuple[str, str]]) -> bytes:
    """A resource table with one package 0x7f, one type and string values (key, text) in the default configuration."""
    n = lambda v, size=4: v.to_bytes(size, "little")
    texts, keys = write_pool([t for _, t in values]), write_pool([k for k, _ in values])
    types = write_pool([kind])
    entries = b"".join(n(8, 2) + n(0, 2) + n(i) + n(8, 2) + n(0, 1) + n(STRING, 1) + n(i) for i in range(len(values)))
    offsets = b"".join(n(16 * i) for i in range(len(values)))
    header = 20 + 64
    chunk = n(TYPE, 2) + n(header, 2) + n(header + len(offsets) + len(entries)) + n(1, 1) + n(0, 3) + n(len(values)) + n(header + len(offsets)) + n(64) + bytes(60) + offsets + entries
    name = package.encode("utf-16-le")[:254].ljust(256, b"\0")
    body = n(0x7F) + name + n(288) + n(0) + n(288 + len(types)) + n(0) + n(0)
    package_ = n(PACKAGE, 2) + n(288, 2) + n(288 + len(types) + len(keys) + len(chunk)) + body + types + keys + chunk
    return n(TABLE, 2) + n(12, 2) + n(12 + len(texts) + len(package_)) + n(1) + texts + package_


__all__ = ["STRING", "config_text", "resources", "write"]
