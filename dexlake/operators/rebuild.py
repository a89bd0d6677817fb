"""A class cut out of its DEX: a small DEX of its own with only the pool rows that the class needs.

The class is read into a description whose references are symbols, and written anew: pools come out sorted, indices in the code are put right, header and
checksums are sealed.  Debug programs, annotations and static values aren't carried; bodies that refer to call sites or method handles can't be.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from dexlake.formats import synth, zip
from dexlake.formats.binary import NO_INDEX, FormatError, u16, u32
from dexlake.formats.dex import Dex, members
from dexlake.formats.opcodes import references
from dexlake.operators.artifacts import per_artifact


def _member(dex: Dex, pool: str, i: int) -> tuple[str, str, str]:
    at = dex.row(pool, i)
    owner, second, name = dex.descriptor(u16(dex.data, at)), u16(dex.data, at + 2), dex.string(u32(dex.data, at + 4))
    return owner, name, dex.descriptor(second) if pool == "field" else dex.signature_of(second)


def _code(dex: Dex, off: int) -> synth.Code:
    c = dex.code(off)
    symbols = {"string": dex.string, "type": dex.descriptor, "field": lambda i: _member(dex, "field", i), "method": lambda i: _member(dex, "method", i), "proto": dex.signature_of}
    found = []
    for at, op, slot, kind, index in references(c["insns"]):
        if kind not in symbols:
            raise FormatError(f"a reference to a {kind} can't be carried")
        found.append((at + (3 if slot else 1), kind, symbols[kind](index), 4 if op == 0x1B else 2))
    tries: dict[int, tuple[int, int, list]] = {}
    for k, start, count, _, kind, addr in c["handlers"]:
        tries.setdefault(k, (start, count, []))[2].append((kind, addr))
    return synth.Code(c["registers"], c["ins"], c["outs"], c["insns"], found, [tries[k] for k in sorted(tries)])


def class_of(dex: Dex, descriptor: str) -> synth.Class | None:
    """The description of the first class definition with a descriptor."""
    for i in range(dex.pools["class_def"][0]):
        at = dex.row("class_def", i)
        kind, flags, above, ifaces, source, _, data, _ = (u32(dex.data, at + 4 * k) for k in range(8))
        if dex.descriptor(kind) != descriptor:
            continue
        made = synth.Class(descriptor, None if above == NO_INDEX else dex.descriptor(above), dex.type_list(ifaces), flags, None if source == NO_INDEX else dex.string(source))
        for what, which, _, index, access, code in dex.class_data(data) if data else ():
            if what == "field":
                _, name, type_ = _member(dex, "field", index)
                made.fields.append((name, type_, access, which == 0))
            else:
                _, name, signature = _member(dex, "method", index)
                made.methods.append(synth.Method(name, signature, access, None, which == 1, _code(dex, code) if code else None))
        return made
    return None


def rebuilt(data: bytes, descriptor: str) -> bytes | None:
    """A DEX with one class of ``data``; its version is kept, except that a container becomes a plain file."""
    for at in members(data):
        dex = Dex(data, at)
        if made := class_of(dex, descriptor):
            return synth.build([made], version=(b"039" if dex.version == "041" else dex.version.encode()))
    return None


def rebuilt_classes(artifacts: DataFrame, descriptor: str) -> DataFrame:
    """(aid, dex_name, content, error): the class from the first DEX of each artifact that defines it."""

    def rows(data: bytes) -> Iterator[dict]:
        files = [("classes.dex", data)] if data[:4] == b"dex\n" else [(e.name, zip.read(data, e)) for e in zip.dex_entries(zip.entries(data))]
        for name, raw in files:
            content = rebuilt(raw, descriptor)
            if content is not None:
                yield {"dex_name": name, "content": content}
                return
        raise FormatError("no DEX defines the class")

    return per_artifact(artifacts, rows, "dex_name string, content binary")
