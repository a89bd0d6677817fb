"""Exported symbols and static registration tables of ELF libraries."""

from __future__ import annotations

import re

from dexlake.formats.binary import FormatError, part

# Fixed values of the format.
DYNSYM, DYNAMIC_SEGMENT, LOAD = 11, 2, 1
DT_HASH, DT_STRTAB, DT_SYMTAB, DT_STRSZ, DT_GNU_HASH = 4, 5, 6, 10, 0x6FFFFEF5
MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "aarch64"}
MOST_SYMBOLS = 1 << 20
# Fixed values of the format: tags of the relocation tables (address, size, with addend) and the type of a relative one for each machine.
RELOCATIONS = ((7, 8, True), (17, 18, False))
PACKED_RELOCATIONS = ((0x6000000F, 0x60000010, False), (0x60000011, 0x60000012, True))
RELATIVE = {183: 1027, 62: 8, 3: 8, 40: 23, 243: 3}
ARM, EXECUTABLE = 40, 1
MOST_RELOCATIONS, MOST_JNI_ENTRIES = 1 << 20, 65_536
_FIELD = rb"\[*(?:[ZBSCIJFD]|L[^\x00-\x20(.\[;]+;)"
_JNI_NAME = re.compile(rb"[A-Za-z0-9_$\x80-\xff-]{1,255}")
_JNI_SIGNATURE = re.compile(rb"\((?:" + _FIELD + rb")*\)(?:V|" + _FIELD + rb")")


class Elf:
    def __init__(self, data: bytes):
        if data[:4] != b"\x7fELF" or len(data) < 52:
            raise FormatError("no ELF header")
        self.data, self.wide, self.order = data, data[4] == 2, "big" if data[5] == 2 else "little"
        self.machine = MACHINES.get(self.n(18, 2), f"machine{self.n(18, 2)}")
        w = 8 if self.wide else 4
        self.phoff, self.shoff = self.n(24 + w, w), self.n(24 + 2 * w, w)
        at = 24 + 3 * w + 4 + 2
        self.phsize, self.phnum, self.shsize, self.shnum = (self.n(at + 2 * k, 2) for k in range(4))

    def n(self, at: int, size: int) -> int:
        return int.from_bytes(part(self.data, at, size), self.order)

    def _symbols(self, table: int, count: int, names: int, names_size: int) -> list[str]:
        if count > MOST_SYMBOLS:
            raise FormatError(f"{count} symbols")
        found = []
        size = 24 if self.wide else 16
        for k in range(count):
            at = table + k * size
            name = self.n(at, 4)
            info, section = (self.n(at + 4, 1), self.n(at + 6, 2)) if self.wide else (self.n(at + 12, 1), self.n(at + 14, 2))
            if section and info >> 4 in (1, 2) and info & 15 in (0, 1, 2) and name < names_size:
                end = self.data.find(b"\0", names + name, names + names_size)
                if end > names + name:
                    found.append(self.data[names + name : end].decode("utf-8", "replace"))
        return found

    def exports(self) -> list[str]:
        """Names of defined global symbols: from the section table, or from the dynamic segment where there are no sections."""
        w = 8 if self.wide else 4
        off, size, link = (24, 32, 40) if self.wide else (16, 20, 24)
        for k in range(self.shnum):
            at = self.shoff + k * self.shsize
            if self.n(at + 4, 4) == DYNSYM:
                strings = self.shoff + self.n(at + link, 4) * self.shsize
                return self._symbols(self.n(at + off, w), self.n(at + size, w) // (24 if self.wide else 16), self.n(strings + off, w), self.n(strings + size, w))
        segments = []
        for k in range(self.phnum):
            at = self.phoff + k * self.phsize
            o, v, f = (8, 16, 32) if self.wide else (4, 8, 16)
            segments.append((self.n(at, 4), self.n(at + o, w), self.n(at + v, w), self.n(at + f, w)))

        def place(address: int) -> int:
            for kind, o, v, size_ in segments:
                if kind == LOAD and v <= address < v + size_:
                    return o + address - v
            raise FormatError(f"address {address:#x} is in no segment")

        tags: dict[int, int] = {}
        for kind, o, _, size_ in segments:
            if kind == DYNAMIC_SEGMENT:
                for at in range(o, o + size_ - 2 * w + 1, 2 * w):
                    tag = self.n(at, w)
                    if not tag:
                        break
                    tags[tag] = self.n(at + w, w)
        if not {DT_SYMTAB, DT_STRTAB, DT_STRSZ} <= tags.keys():
            return []
        if DT_HASH in tags:
            count = self.n(place(tags[DT_HASH]) + 4, 4)
        elif DT_GNU_HASH in tags:
            at = place(tags[DT_GNU_HASH])
            buckets, first, bloom = self.n(at, 4), self.n(at + 4, 4), self.n(at + 8, 4)
            table = at + 16 + bloom * w
            count = max([first, *(self.n(table + 4 * k, 4) for k in range(buckets))])
            while not self.n(table + 4 * buckets + 4 * (count - first), 4) & 1:
                count += 1
            count += 1
        else:
            return []
        return self._symbols(place(tags[DT_SYMTAB]), count, place(tags[DT_STRTAB]), tags[DT_STRSZ])

    def segments(self) -> list[tuple[int, int, int, int, int]]:
        """(kind, flags, place in the file, address, size in the file) of every segment."""
        w = 8 if self.wide else 4
        o, v, f, flags = (8, 16, 32, 4) if self.wide else (4, 8, 16, 24)
        starts = [self.phoff + k * self.phsize for k in range(self.phnum)]
        return [(self.n(at, 4), self.n(at + flags, 4), self.n(at + o, w), self.n(at + v, w), self.n(at + f, w)) for at in starts]

    def relocations(self, segments: list[tuple]) -> tuple[dict[int, int], set[int], list[str]]:
        """Places of the file whose words are rebased, with their values; places that a symbol fills; what couldn't be read."""
        w = 8 if self.wide else 4
        kind_of = RELATIVE.get(self.n(18, 2))
        tags: dict[int, int] = {}
        for kind, _, o, _, size in segments:
            if kind == DYNAMIC_SEGMENT:
                for at in range(o, min(o + size, len(self.data)) - 2 * w + 1, 2 * w):
                    tag = self.n(at, w)
                    if not tag:
                        break
                    tags.setdefault(tag, self.n(at + w, w))
        relative: dict[int, int] = {}
        symbolic: set[int] = set()
        notes: list[str] = []

        def take(address: int, info: int, addend: int | None) -> None:
            at = placed(segments, address)
            if at is None:
                return
            if info & (0xFFFFFFFF if self.wide else 0xFF) != kind_of:
                symbolic.add(at)
            elif addend is not None:
                relative[at] = addend

        for where, how_long, addends in RELOCATIONS:
            if where in tags and how_long in tags and (start := placed(segments, tags[where])) is not None:
                step = (3 if addends else 2) * w
                count = tags[how_long] // step
                if count > MOST_RELOCATIONS:
                    notes.append(f"more than {MOST_RELOCATIONS} relocations")
                for at in range(start, min(start + min(count, MOST_RELOCATIONS) * step, len(self.data) - step + 1), step):
                    take(self.n(at, w), self.n(at + w, w), self.n(at + 2 * w, w) if addends else None)
        for where, how_long, addends in PACKED_RELOCATIONS:
            if where in tags and how_long in tags:
                start = placed(segments, tags[where])
                try:
                    if start is None:
                        raise FormatError("outside the file")
                    for found in unpacked(part(self.data, start, tags[how_long]), self.wide, addends):
                        take(*found)
                except FormatError as e:
                    notes.append(f"packed relocations: {e}")
        return relative, symbolic, notes

    def jni_tables(self) -> tuple[list[tuple[str, str, int | None]], list[str]]:
        """(name, signature, address of the code or None) of static registration entries, and what couldn't be looked through.

        An entry is three words in a loaded segment without code: a name, a method descriptor and a place with code, or one that a symbol fills.
        """
        segments = self.segments()
        if not segments:
            return [], ["no program headers"]
        relative, symbolic, notes = self.relocations(segments)
        w = 8 if self.wide else 4
        loaded = [s for s in segments if s[0] == LOAD]

        def word(at: int) -> int:
            found = relative.get(at)
            return self.n(at, w) if found is None else found

        def text(address: int, form: re.Pattern) -> str | None:
            at = placed(segments, address) if address else None
            if at is None:
                return None
            end = self.data.find(b"\0", at, at + 4096)
            raw = self.data[at : max(end, at)]
            return raw.decode("utf-8", "replace") if form.fullmatch(raw) else None

        found: dict[tuple, None] = {}
        for _, flags, start, _, size in loaded:
            if flags & EXECUTABLE:
                continue
            at, end = -(-start // w) * w, min(start + size, len(self.data))
            while at + 3 * w <= end:
                step = w
                if (name := text(word(at), _JNI_NAME)) is not None and (signature := text(word(at + w), _JNI_SIGNATURE)) is not None:
                    code: int | None = None
                    if at + 2 * w not in symbolic:
                        code = word(at + 2 * w) & (~1 if self.n(18, 2) == ARM else -1)
                    if code is None or any(f & EXECUTABLE and v <= code < v + n for _, f, _, v, n in loaded):
                        if len(found) >= MOST_JNI_ENTRIES:
                            return list(found), [*notes, f"more than {MOST_JNI_ENTRIES} entries"]
                        found[name, signature, code] = None
                        step = 3 * w
                at += step
        return list(found), notes


def placed(segments: list[tuple], address: int) -> int | None:
    """Where in the file an address is loaded from."""
    for kind, _, o, v, size in segments:
        if kind == LOAD and v <= address < v + size:
            return o + address - v
    return None


def unpacked(raw: bytes, wide: bool, addends: bool):
    """(address, info, addend) of a packed relocation table: groups of differences, of which a group may share some."""
    if raw[:4] != b"APS2":
        raise FormatError("no APS2 table")
    mask = (1 << 64 if wide else 1 << 32) - 1
    at = 4

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(raw) or shift >= 70:
                raise FormatError("broken number")
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return (value - (1 << shift) if b & 0x40 else value) & mask

    total, place = number(), number()
    info = addend = done = 0
    while done < total:
        size, flags = number(), number()
        same_info, same_step, same_addend, has_addend = (bool(flags & f) for f in (1, 2, 4, 8))
        if not 0 < size <= total - done or has_addend and not addends or done + size > MOST_RELOCATIONS:
            raise FormatError("broken group")
        step = number() if same_step else 0
        info = number() if same_info else info
        addend = (addend + number()) & mask if has_addend and same_addend else addend if has_addend else 0
        for _ in range(size):
            place = (place + (step if same_step else number())) & mask
            info = info if same_info else number()
            if has_addend and not same_addend:
                addend = (addend + number()) & mask
            yield place, info, addend if addends else None
        done += size


def write(symbols: list[str], entries: list[tuple[str, str]] = (), machine: int = 183) -> bytes:
    """A 64-bit library with exported symbols and, where there are any, a static registration table that relative relocations fill."""
    strings, at_of = bytearray(b"\0"), {}
    for s in [*symbols, *(x for e in entries for x in e)]:
        at_of[s] = len(strings)
        strings += s.encode() + b"\0"
    n = lambda v, size=8: v.to_bytes(size, "little")
    code, sections = 64 + 3 * 56, 64 + 3 * 56 + 16
    names = sections
    table = -(-(names + len(strings)) // 8) * 8
    relas = table + 24 * len(entries)
    hashes = relas + 24 * 3 * len(entries)
    syms = hashes + 8
    dynamic = syms + 24 * (len(symbols) + 1)
    tags = [(DT_HASH, hashes), (DT_STRTAB, names), (DT_SYMTAB, syms), (DT_STRSZ, len(strings)), (7, relas), (8, 72 * len(entries)), (0, 0)]
    end = dynamic + 16 * len(tags)
    head = b"\x7fELF\x02\x01\x01".ljust(16, b"\0") + n(3, 2) + n(machine, 2) + n(1, 4) + n(0) + n(64) + n(0) + n(0, 4) + n(64, 2) + n(56, 2) + n(3, 2) + n(64, 2) + n(0, 2) + n(0, 2)
    segment = lambda kind, flags, o, size: n(kind, 4) + n(flags, 4) + n(o) + n(o) + n(o) + n(size) + n(size) + n(8)
    out = head + segment(LOAD, 5, code, 16) + segment(LOAD, 6, sections, end - sections) + segment(DYNAMIC_SEGMENT, 6, dynamic, 16 * len(tags))
    out = (out + bytes(16) + bytes(strings)).ljust(table, b"\0") + bytes(24 * len(entries))
    for k, (name, signature) in enumerate(entries):
        for j, value in enumerate((names + at_of[name], names + at_of[signature], code)):
            out += n(table + 24 * k + 8 * j) + n(RELATIVE[machine]) + n(value)
    out += n(1, 4) + n(len(symbols) + 1, 4) + bytes(24)
    for s in symbols:
        out += n(at_of[s], 4) + n(0x12, 1) + n(0, 1) + n(1, 2) + n(code) + n(4)
    return out + b"".join(n(a) + n(b) for a, b in tags)
