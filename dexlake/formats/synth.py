"""Building DEX files from descriptions: for round trips (what is written from rows must come back as those rows) and for rebuilt classes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from dexlake.formats.binary import NO_INDEX, mutf8_bytes, put_sleb, put_uleb


@dataclass
class Method:
    """Instructions are ("string", text), ("type", descriptor), ("field", label parts), ("call", (class, name, signature)) or ("raw", units)."""

    name: str
    signature: str = "()V"
    flags: int = 1
    body: list[tuple] | None = None
    virtual: bool = True
    code: Code | None = None  # a body taken from another file, instead of ``body``


@dataclass
class Code:
    """A body whose references are symbols: (unit offset of the index, kind, symbol, bytes wide)."""

    registers: int
    ins: int
    outs: int
    insns: bytes
    references: list[tuple[int, str, object, int]] = field(default_factory=list)
    tries: list[tuple[int, int, list[tuple[str | None, int]]]] = field(default_factory=list)  # start, count, handlers (type or None for all, address)


@dataclass
class Class:
    descriptor: str
    parent: str | None = "Ljava/lang/Object;"
    interfaces: list[str] = field(default_factory=list)
    flags: int = 1
    source: str | None = None
    fields: list[tuple[str, str, int, bool]] = field(default_factory=list)  # name, type, flags, static
    methods: list[Method] = field(default_factory=list)


def split_signature(signature: str) -> tuple[list[str], str]:
    inner, result = signature[1:].split(")")
    params, at = [], 0
    while at < len(inner):
        start = at
        while inner[at] == "[":
            at += 1
        at = inner.index(";", at) + 1 if inner[at] == "L" else at + 1
        params.append(inner[start:at])
    return params, result


def _shorty(params: list[str], result: str) -> str:
    return "".join("L" if x[0] in "L[" else x for x in [result, *params])


def build(classes: list[Class], *, version: bytes = b"035", tail: bytes = b"", checksum: int | None = None) -> bytes:
    """A DEX file of ``classes``."""
    strings: set[str] = set()
    types: set[str] = set()
    protos: set[tuple[str, ...]] = set()
    fields: set[tuple[str, str, str]] = set()
    methods: set[tuple[str, str, str]] = set()

    def use_method(owner: str, name: str, signature: str) -> None:
        params, result = split_signature(signature)
        methods.add((owner, name, signature))
        types.update((owner, result, *params))
        strings.update((name, _shorty(params, result)))
        protos.add((result, *params))

    for c in classes:
        types.add(c.descriptor)
        types.update(c.interfaces)
        if c.parent:
            types.add(c.parent)
        if c.source is not None:
            strings.add(c.source)
        for name, kind, _, _ in c.fields:
            fields.add((c.descriptor, name, kind))
        for m in c.methods:
            use_method(c.descriptor, m.name, m.signature)
            carried = [("call" if kind == "method" else kind, x) for _, kind, x, _ in m.code.references] if m.code else []
            carried += [("type", t) for _, _, handlers in m.code.tries for t, _ in handlers if t] if m.code else []
            for what, x in [*(m.body or ()), *carried]:
                if what == "string":
                    strings.add(x)
                elif what == "type":
                    types.add(x)
                elif what == "field":
                    fields.add(x)
                elif what == "call":
                    use_method(*x)
                elif what == "proto":
                    params, result = split_signature(x)
                    types.update((result, *params))
                    strings.add(_shorty(params, result))
                    protos.add((result, *params))
    for owner, name, kind in fields:
        types.update((owner, kind))
        strings.add(name)
    strings |= types
    string_list = sorted(strings, key=lambda s: s.encode("utf-16-be", "surrogatepass"))
    sid = {s: i for i, s in enumerate(string_list)}
    type_list = sorted(types, key=sid.__getitem__)
    tid = {t: i for i, t in enumerate(type_list)}
    proto_list = sorted(protos, key=lambda p: [tid[x] for x in p])
    pid = {p: i for i, p in enumerate(proto_list)}
    proto_of = lambda signature: pid[(lambda x: (x[1], *x[0]))(split_signature(signature))]
    field_list = sorted(fields, key=lambda f: (tid[f[0]], sid[f[1]], tid[f[2]]))
    fid = {f: i for i, f in enumerate(field_list)}
    method_list = sorted(methods, key=lambda m: (tid[m[0]], sid[m[1]], proto_of(m[2])))
    mid = {m: i for i, m in enumerate(method_list)}

    header = 0x78 if version == b"041" else 0x70
    sizes = [("string", len(string_list), 4), ("type", len(type_list), 4), ("proto", len(proto_list), 12), ("field", len(field_list), 8), ("method", len(method_list), 8), ("class_def", len(classes), 32)]
    offs, at = {}, header
    for name, n, width in sizes:
        offs[name] = at
        at += n * width
    data_off = at
    data = bytearray()
    here = lambda: data_off + len(data)

    def align() -> None:
        data.extend(b"\0" * (-here() % 4))

    lists: dict[tuple[str, ...], int] = {}

    def list_at(items: tuple[str, ...]) -> int:
        if not items:
            return 0
        if items not in lists:
            align()
            lists[items] = here()
            data.extend(struct.pack("<I", len(items)) + b"".join(struct.pack("<H", tid[x]) for x in items))
        return lists[items]

    string_at = []
    for s in string_list:
        string_at.append(here())
        data.extend(put_uleb(len(s.encode("utf-16-le", "surrogatepass")) // 2) + mutf8_bytes(s) + b"\0")
    proto_rows = b"".join(struct.pack("<III", sid[_shorty(list(p[1:]), p[0])], tid[p[0]], list_at(p[1:])) for p in proto_list)

    def carried_at(c: Code) -> int:
        raw = bytearray(c.insns)
        numbers = {"string": sid.__getitem__, "type": tid.__getitem__, "field": fid.__getitem__, "method": mid.__getitem__, "proto": proto_of}
        for unit, kind, symbol, width in c.references:
            raw[unit * 2 : unit * 2 + width] = numbers[kind](symbol).to_bytes(width, "little")
        align()
        start = here()
        data.extend(struct.pack("<HHHHII", c.registers, c.ins, c.outs, len(c.tries), 0, len(raw) // 2) + raw)
        if c.tries:
            data.extend(b"\0" * (len(raw) % 4))
            lists_, places = bytearray(put_uleb(len(c.tries))), []
            for _, _, handlers in c.tries:
                places.append(len(lists_))
                typed = [(t, a) for t, a in handlers if t]
                rest = [a for t, a in handlers if not t]
                lists_ += put_sleb(-len(typed) if rest else len(typed)) + b"".join(put_uleb(tid[t]) + put_uleb(a) for t, a in typed) + b"".join(put_uleb(a) for a in rest)
            for (first, count, _), place in zip(c.tries, places, strict=True):
                data.extend(struct.pack("<IHH", first, count, place))
            data.extend(lists_)
        return start

    def code_at(m: Method) -> int:
        if m.code:
            return carried_at(m.code)
        units: list[int] = []
        for what, x in m.body or ():
            if what == "string":
                i = sid[x]
                units += [0x001A, i] if i < 0x10000 else [0x001B, i & 0xFFFF, i >> 16]
            elif what == "type":
                units += [0x001C, tid[x]]
            elif what == "field":
                units += [0x0060, fid[x]]
            elif what == "call":
                units += [0x0071, mid[x], 0]
            else:
                units += x
        units.append(0x000E)
        align()
        start = here()
        data.extend(struct.pack("<HHHHII", 16, 0, 4, 0, 0, len(units)) + struct.pack(f"<{len(units)}H", *units))
        return start

    class_rows = b""
    for c in classes:
        ifaces = list_at(tuple(c.interfaces))
        groups: list[list[bytes]] = []
        for static in (True, False):
            own = sorted((fid[c.descriptor, n, t], f) for n, t, f, s in c.fields if s == static)
            groups.append([put_uleb(i - (own[k - 1][0] if k else 0)) + put_uleb(f) for k, (i, f) in enumerate(own)])
        for virtual in (False, True):
            own = sorted(((mid[c.descriptor, m.name, m.signature], m) for m in c.methods if m.virtual == virtual), key=lambda x: x[0])
            groups.append([put_uleb(i - (own[k - 1][0] if k else 0)) + put_uleb(m.flags) + put_uleb(code_at(m) if m.body is not None or m.code is not None else 0) for k, (i, m) in enumerate(own)])
        members_at = 0
        if any(groups):
            members_at = here()
            data.extend(b"".join(put_uleb(len(g)) for g in groups) + b"".join(b"".join(g) for g in groups))
        class_rows += struct.pack("<8I", tid[c.descriptor], c.flags, tid[c.parent] if c.parent else NO_INDEX, ifaces, NO_INDEX if c.source is None else sid[c.source], 0, members_at, 0)
    align()
    map_at = here()
    items = [(0x0000, 1, 0)] + [(k, n, offs[name]) for k, (name, n, _) in enumerate(sizes, 1) if n] + [(0x1000, 1, map_at)]
    data.extend(struct.pack("<I", len(items)) + b"".join(struct.pack("<HHII", k, 0, n, o) for k, n, o in items))
    size = data_off + len(data)
    pools = b"".join(struct.pack("<II", n, offs[name] if n else 0) for name, n, _ in sizes)
    rest = struct.pack("<IIIIII", size, header, 0x12345678, 0, 0, map_at) + pools + struct.pack("<II", len(data), data_off)
    if version == b"041":
        rest += struct.pack("<II", size, 0)
    tables = b"".join(struct.pack("<I", x) for x in string_at) + b"".join(struct.pack("<I", sid[t]) for t in type_list) + proto_rows
    tables += b"".join(struct.pack("<HHI", tid[c], tid[t], sid[n]) for c, n, t in field_list) + b"".join(struct.pack("<HHI", tid[c], proto_of(s), sid[n]) for c, n, s in method_list) + class_rows
    body = rest + tables + bytes(data)
    signed = hashlib.sha1(body).digest() + body
    return b"dex\n" + version + b"\0" + struct.pack("<I", zlib.adler32(signed) if checksum is None else checksum) + signed + tail
