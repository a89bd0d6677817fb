"""DEX files as rows of normalised tables.

A file is read once; everything that can't be read becomes an ``issue`` row, and what was read before it stays.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

from dexlake.formats.binary import NO_INDEX, FormatError, mutf8_end, mutf8_text, part, sleb, u16, u32, uleb
from dexlake.formats.opcodes import references

# Fixed values of the format.
VERSIONS = {b"035": "035", b"037": "037", b"038": "038", b"039": "039", b"040": "040", b"041": "041"}
POOLS = {"string": (0x38, 4), "type": (0x40, 4), "proto": (0x48, 12), "field": (0x50, 8), "method": (0x58, 8), "class_def": (0x60, 32)}
HEADER_SIZE, HEADER_SIZE_041, ENDIAN = 0x70, 0x78, 0x12345678
MAP_CALL_SITES, MAP_HANDLES, MAP_LIST = 0x0007, 0x0008, 0x1000
MAP_ITEM_SIZES = {0x0000: HEADER_SIZE, 0x0001: 4, 0x0002: 4, 0x0003: 12, 0x0004: 8, 0x0005: 8, 0x0006: 32, 0x0007: 4, 0x0008: 8}
MAP_STRING_DATA = 0x2002
MOST_MEMBERS, MOST_LIST, DEEPEST = 1024, 1 << 20, 64

#: Tables and their columns: kinds i (number), s (text), b (bytes), a (texts).
TABLES = {
    "dex": "dex_name:s version:s status:s header_off:i file_size:i checksum:i adler:i sha1_ok:i data_end:i span:i entry_name:s",
    "string": "string_idx:i utf16_len:i mutf8:b text:s",
    "type": "type_idx:i string_idx:i descriptor:s",
    "proto": "proto_idx:i shorty:s return_type:s params:a",
    "field": "field_idx:i class_type_idx:i type_idx:i name_idx:i class_descriptor:s name:s type_descriptor:s",
    "method": "method_idx:i class_type_idx:i proto_idx:i name_idx:i class_descriptor:s name:s signature:s",
    "method_handle": "handle_idx:i handle_type:i target_idx:i",
    "call_site": "call_site_idx:i off:i items:s",
    "class_def": "class_def_idx:i class_type_idx:i access_flags:i descriptor:s super_descriptor:s source_file:s",
    "class_interface": "class_def_idx:i ord:i descriptor:s",
    "class_field": "class_def_idx:i list:i ord:i field_idx:i access_flags:i",
    "class_method": "class_def_idx:i list:i ord:i method_idx:i access_flags:i code_off:i",
    "code_item": "code_off:i registers:i ins:i outs:i tries:i insns_units:i insns:b",
    "code_try": "code_off:i ord:i start:i count:i addr:i handler:i type_descriptor:s",
    "code_ref": "code_off:i offset:i opcode:i slot:i ref_idx:i ref_kind:s",
    "debug_line": "code_off:i ord:i pc:i line:i line_start:i",
    "static_value": "class_def_idx:i ord:i value:s",
    "annotation": "class_def_idx:i ord:i visibility:i type_descriptor:s elements:s",
    "map_item": "item_type:i size:i offset:i",
    "issue": "stage:s message:s failed:i",
}


class Dex:
    """One logical DEX inside ``data``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        magic = part(data, at, 8)
        if magic[:4] != b"dex\n" or magic[7] or magic[4:7] not in VERSIONS:
            raise FormatError("no DEX header, or a version that isn't known")
        self.version = VERSIONS[magic[4:7]]
        part(data, at, HEADER_SIZE)
        self.checksum, self.file_size = u32(data, at + 8), u32(data, at + 0x20)
        self.signature = data[at + 12 : at + 32]
        header = u32(data, at + 0x24)
        if u32(data, at + 0x28) != ENDIAN:
            raise FormatError("byte order mark")
        if header < (HEADER_SIZE_041 if self.version == "041" else HEADER_SIZE):
            raise FormatError(f"header of {header} bytes")
        #: Offsets count from the start of the container.
        self.pools = {name: (u32(data, at + off), u32(data, at + off + 4)) for name, (off, _) in POOLS.items()}
        for name, (size, off) in self.pools.items():
            if size and off + size * POOLS[name][1] > len(data):
                raise FormatError(f"{name} pool is beyond the end")
        self.map_off = u32(data, at + 0x34)
        self._strings: dict[int, str] = {}

    def row(self, pool: str, i: int) -> int:
        size, off = self.pools[pool]
        if not 0 <= i < size:
            raise FormatError(f"{pool} {i} of {size}")
        return off + i * POOLS[pool][1]

    def raw_string(self, i: int) -> tuple[int, bytes]:
        length, at = uleb(self.data, u32(self.data, self.row("string", i)))
        return length, self.data[at : mutf8_end(self.data, at)]

    def string(self, i: int) -> str:
        if i not in self._strings:
            self._strings[i] = mutf8_text(self.raw_string(i)[1])
        return self._strings[i]

    def descriptor(self, i: int) -> str:
        return self.string(u32(self.data, self.row("type", i)))

    def type_list(self, off: int) -> list[str]:
        if not off:
            return []
        n = u32(self.data, off)
        part(self.data, off + 4, 2 * n)
        return [self.descriptor(u16(self.data, off + 4 + 2 * k)) for k in range(n)]

    def proto(self, i: int) -> tuple[str, str, list[str]]:
        at = self.row("proto", i)
        return self.string(u32(self.data, at)), self.descriptor(u32(self.data, at + 4)), self.type_list(u32(self.data, at + 8))

    def signature_of(self, i: int) -> str:
        _, result, params = self.proto(i)
        return f"({''.join(params)}){result}"

    def map_items(self) -> list[tuple[int, int, int]]:
        if not self.map_off:
            return []
        n = u32(self.data, self.map_off)
        part(self.data, self.map_off + 4, 12 * n)
        return [(u16(self.data, p), u32(self.data, p + 4), u32(self.data, p + 8)) for p in range(self.map_off + 4, self.map_off + 4 + 12 * n, 12)]

    def data_end(self) -> int | None:
        """Where the last item of the map ends; None where that can't be known."""
        items = self.map_items()
        if self.version == "041" or not items:
            return None
        kind, size, off = max(items, key=lambda x: x[2])
        if kind in MAP_ITEM_SIZES:
            end = off + size * MAP_ITEM_SIZES[kind]
        elif kind == MAP_LIST:
            end = off + 4 + 12 * len(items)
        elif kind == MAP_STRING_DATA:
            end = off
            for _ in range(size):
                _, end = uleb(self.data, end)
                end = mutf8_end(self.data, end) + 1
        else:
            return None
        link = u32(self.data, self.at + 0x2C), u32(self.data, self.at + 0x30)
        end = max(end, sum(link) if link[0] else 0)
        return end if end <= self.file_size else None

    # encoded values -------------------------------------------------------------------------------------------------

    def value(self, at: int, depth: int = 0):
        """An encoded value as JSON can hold it, and what follows."""
        if depth > DEEPEST:
            raise FormatError("values nest too deep")
        head = part(self.data, at, 1)[0]
        kind, arg, at = head & 0x1F, head >> 5, at + 1
        if kind == 0x1C:
            return self.array(at, depth + 1)
        if kind == 0x1D:
            return self.annotation_value(at, depth + 1)
        if kind == 0x1E:
            return None, at
        if kind == 0x1F:
            return bool(arg), at
        raw = part(self.data, at, arg + 1)
        at += arg + 1
        if kind in (0x00, 0x02, 0x04, 0x06):
            return int.from_bytes(raw, "little", signed=True), at
        if kind == 0x10:
            return struct.unpack("<f", raw.rjust(4, b"\0"))[0], at
        if kind == 0x11:
            return struct.unpack("<d", raw.rjust(8, b"\0"))[0], at
        n = int.from_bytes(raw, "little")
        if kind == 0x03:
            return n, at
        if kind == 0x15:
            return {"proto": self.signature_of(n)}, at
        if kind == 0x16:
            return {"method_handle": n}, at
        if kind == 0x17:
            return self.string(n), at
        if kind == 0x18:
            return {"type": self.descriptor(n)}, at
        if kind in (0x19, 0x1B):
            return {"field" if kind == 0x19 else "enum": self.label("field", n)}, at
        if kind == 0x1A:
            return {"method": self.label("method", n)}, at
        raise FormatError(f"value of kind {kind:#x}")

    def array(self, at: int, depth: int = 0):
        n, at = uleb(self.data, at)
        found = []
        for _ in range(n):
            v, at = self.value(at, depth)
            found.append(v)
        return found, at

    def annotation_value(self, at: int, depth: int = 0):
        kind, at = uleb(self.data, at)
        n, at = uleb(self.data, at)
        found = {}
        for _ in range(n):
            name, at = uleb(self.data, at)
            v, at = self.value(at, depth)
            found[self.string(name)] = v
        return {"annotation": self.descriptor(kind), "elements": found}, at

    def label(self, pool: str, i: int) -> str:
        at = self.row(pool, i)
        return f"{self.descriptor(u16(self.data, at))}->{self.string(u32(self.data, at + 4))}"

    # classes and code -----------------------------------------------------------------------------------------------

    def class_data(self, off: int) -> Iterator[tuple[str, int, int, int, int, int]]:
        """(field or method, list, ordinal, index, flags, code offset) in the order of the file."""
        sizes = []
        for _ in range(4):
            n, off = uleb(self.data, off)
            if n > MOST_LIST:
                raise FormatError(f"{n} members")
            sizes.append(n)
        for k, n in enumerate(sizes):
            index = 0
            for ordinal in range(n):
                step, off = uleb(self.data, off)
                flags, off = uleb(self.data, off)
                index += step
                code = 0
                if k > 1:
                    code, off = uleb(self.data, off)
                yield ("field" if k < 2 else "method", k % 2, ordinal, index, flags, code)

    def code(self, off: int) -> dict:
        d = self.data
        units = u32(d, off + 12)
        found = {"registers": u16(d, off), "ins": u16(d, off + 2), "outs": u16(d, off + 4), "tries": u16(d, off + 6), "debug": u32(d, off + 8), "units": units, "insns": part(d, off + 16, units * 2), "handlers": []}
        if found["tries"]:
            at = off + 16 + units * 2 + (units % 2) * 2
            base = at + 8 * found["tries"]
            for k in range(found["tries"]):
                start, count, rel = u32(d, at + 8 * k), u16(d, at + 8 * k + 4), u16(d, at + 8 * k + 6)
                n, p = sleb(d, base + rel)
                for h in range(abs(n)):
                    kind, p = uleb(d, p)
                    addr, p = uleb(d, p)
                    found["handlers"].append((k, start, count, h, self.descriptor(kind), addr))
                if n <= 0:
                    addr, p = uleb(d, p)
                    found["handlers"].append((k, start, count, abs(n), None, addr))
        return found

    def lines(self, off: int) -> tuple[int, list[tuple[int, int]]]:
        """First line and the (pc, line) rows that a debug program emits."""
        line, at = uleb(self.data, off)
        first, pc, rows = line, 0, []
        n, at = uleb(self.data, at)
        for _ in range(n):
            _, at = uleb(self.data, at)
        while True:
            op = part(self.data, at, 1)[0]
            at += 1
            if op == 0:
                return first, rows
            if op == 1:
                step, at = uleb(self.data, at)
                pc += step
            elif op == 2:
                step, at = sleb(self.data, at)
                line += step
            elif op in (3, 4):
                for _ in range(op):
                    _, at = uleb(self.data, at)
            elif op in (5, 6, 9):
                _, at = uleb(self.data, at)
            elif op > 9:
                line += (op - 10) % 15 - 4
                pc += (op - 10) // 15
                rows.append((pc, line))


def members(data: bytes) -> list[int]:
    """Offsets of the logical DEXes: one, or the members of a version 041 container."""
    if data[:8] != b"dex\n041\0":
        return [0]
    found, at = [], 0
    while at < len(data) and len(found) < MOST_MEMBERS:
        found.append(at)
        if data[at : at + 4] != b"dex\n":
            break
        size = u32(data, at + 0x20)
        if size < HEADER_SIZE_041:
            break
        at += size
    return found


def logical_name(name: str, k: int, count: int) -> str:
    return f"{name}!classes{'' if k == 0 else k + 1}.dex" if count > 1 else name


def rows(data: bytes, name: str) -> Iterator[tuple[int, str, dict]]:
    """(logical ordinal, table, columns) of everything in a DEX file."""
    starts = members(data)
    for k, at in enumerate(starts):
        shown = logical_name(name, k, len(starts))
        base = {"dex_name": shown, "entry_name": name, "header_off": at, "span": (starts[k + 1] if k + 1 < len(starts) else len(data)) - at}
        if data[at : at + 4] != b"dex\n":
            yield k, "dex", base | {"status": "skipped"}
            yield k, "issue", {"stage": "magic", "message": f"{shown}: no DEX", "failed": 0}
            continue
        try:
            dex = Dex(data, at)
        except FormatError as e:
            yield k, "dex", base | {"status": "failed"}
            yield k, "issue", {"stage": "header", "message": f"{shown}: {e}", "failed": 1}
            continue
        end = at + dex.file_size
        try:
            stop = dex.data_end()
        except FormatError:
            stop = None
        yield k, "dex", base | {"status": "view", "version": dex.version, "file_size": dex.file_size, "checksum": dex.checksum, "adler": zlib.adler32(data[at + 12 : end]), "sha1_ok": int(hashlib.sha1(data[at + 32 : end]).digest() == dex.signature), "data_end": stop}
        for table, read in READERS.items():
            try:
                for found in read(dex):
                    yield k, *(found if isinstance(found, tuple) else (table, found))
            except FormatError as e:
                yield k, "issue", {"stage": table, "message": f"{shown}: {e}", "failed": 1}


def _strings(dex: Dex):
    for i in range(dex.pools["string"][0]):
        n, raw = dex.raw_string(i)
        yield {"string_idx": i, "utf16_len": n, "mutf8": raw, "text": mutf8_text(raw)}


def _types(dex: Dex):
    for i in range(dex.pools["type"][0]):
        yield {"type_idx": i, "string_idx": u32(dex.data, dex.row("type", i)), "descriptor": dex.descriptor(i)}


def _protos(dex: Dex):
    for i in range(dex.pools["proto"][0]):
        shorty, result, params = dex.proto(i)
        yield {"proto_idx": i, "shorty": shorty, "return_type": result, "params": params}


def _fields(dex: Dex):
    for i in range(dex.pools["field"][0]):
        at = dex.row("field", i)
        c, t, n = u16(dex.data, at), u16(dex.data, at + 2), u32(dex.data, at + 4)
        yield {"field_idx": i, "class_type_idx": c, "type_idx": t, "name_idx": n, "class_descriptor": dex.descriptor(c), "name": dex.string(n), "type_descriptor": dex.descriptor(t)}


def _methods(dex: Dex):
    for i in range(dex.pools["method"][0]):
        at = dex.row("method", i)
        c, p, n = u16(dex.data, at), u16(dex.data, at + 2), u32(dex.data, at + 4)
        yield {"method_idx": i, "class_type_idx": c, "proto_idx": p, "name_idx": n, "class_descriptor": dex.descriptor(c), "name": dex.string(n), "signature": dex.signature_of(p)}


def _maps(dex: Dex):
    for kind, size, off in dex.map_items():
        yield {"item_type": kind, "size": size, "offset": off}
    for kind, size, off in dex.map_items():
        if kind == MAP_HANDLES:
            for i in range(size):
                yield "method_handle", {"handle_idx": i, "handle_type": u16(dex.data, off + 8 * i), "target_idx": u16(dex.data, off + 8 * i + 4)}
        elif kind == MAP_CALL_SITES:
            for i in range(size):
                where = u32(dex.data, off + 4 * i)
                yield "call_site", {"call_site_idx": i, "off": where, "items": json.dumps(dex.array(where)[0])}


def _annotations(dex: Dex, i: int, off: int):
    sets = [u32(dex.data, off)]
    n = [u32(dex.data, off + 4 + 4 * k) for k in range(3)]
    sets += [u32(dex.data, off + 16 + 8 * k + 4) for k in range(n[0] + n[1])]
    ordinal = 0
    for where in sets:
        if where:
            for k in range(u32(dex.data, where)):
                item = u32(dex.data, where + 4 + 4 * k)
                v, _ = dex.annotation_value(item + 1)
                yield "annotation", {"class_def_idx": i, "ord": ordinal, "visibility": part(dex.data, item, 1)[0], "type_descriptor": v["annotation"], "elements": json.dumps(v["elements"])}
                ordinal += 1


def _classes(dex: Dex):
    seen: set[int] = set()
    for i in range(dex.pools["class_def"][0]):
        at = dex.row("class_def", i)
        kind, flags, above, ifaces, source, notes, data, values = (u32(dex.data, at + 4 * k) for k in range(8))
        yield {"class_def_idx": i, "class_type_idx": kind, "access_flags": flags, "descriptor": dex.descriptor(kind), "super_descriptor": None if above == NO_INDEX else dex.descriptor(above), "source_file": None if source == NO_INDEX else dex.string(source)}
        try:
            for k, x in enumerate(dex.type_list(ifaces)):
                yield "class_interface", {"class_def_idx": i, "ord": k, "descriptor": x}
            if values:
                for k, v in enumerate(dex.array(values)[0]):
                    yield "static_value", {"class_def_idx": i, "ord": k, "value": json.dumps(v)}
            if notes:
                yield from _annotations(dex, i, notes)
            for what, which, k, index, flags, code in dex.class_data(data) if data else ():
                if what == "field":
                    yield "class_field", {"class_def_idx": i, "list": which, "ord": k, "field_idx": index, "access_flags": flags}
                    continue
                yield "class_method", {"class_def_idx": i, "list": which, "ord": k, "method_idx": index, "access_flags": flags, "code_off": code}
                if code and code not in seen:
                    seen.add(code)
                    yield from _code(dex, code)
        except FormatError as e:
            yield "issue", {"stage": "class", "message": f"class {i}: {e}", "failed": 1}


def _code(dex: Dex, off: int):
    try:
        c = dex.code(off)
        yield "code_item", {"code_off": off, "registers": c["registers"], "ins": c["ins"], "outs": c["outs"], "tries": c["tries"], "insns_units": c["units"], "insns": c["insns"]}
        for k, start, count, h, kind, addr in c["handlers"]:
            yield "code_try", {"code_off": off, "ord": k, "start": start, "count": count, "addr": addr, "handler": h, "type_descriptor": kind}
        for at, op, slot, kind, index in references(c["insns"]):
            yield "code_ref", {"code_off": off, "offset": at, "opcode": op, "slot": slot, "ref_idx": index, "ref_kind": kind}
        if c["debug"]:
            first, lines = dex.lines(c["debug"])
            for k, (pc, line) in enumerate(lines):
                yield "debug_line", {"code_off": off, "ord": k, "pc": pc, "line": line, "line_start": first}
    except FormatError as e:
        yield "issue", {"stage": "code", "message": f"code at {off}: {e}", "failed": 1}


READERS = {"string": _strings, "type": _types, "proto": _protos, "field": _fields, "method": _methods, "map_item": _maps, "class_def": _classes}
