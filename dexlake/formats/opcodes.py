"""Dalvik instructions: width in 16-bit units, operand format and what they refer to, from ranges of opcodes."""

from __future__ import annotations

from dexlake.formats.binary import FormatError, u16, u32

# Fixed values of the instruction set: first opcode, last opcode, format.
FORMATS = [
    (0x00, 0x00, "10x"), (0x01, 0x01, "12x"), (0x02, 0x02, "22x"), (0x03, 0x03, "32x"), (0x04, 0x04, "12x"), (0x05, 0x05, "22x"),
    (0x06, 0x06, "32x"), (0x07, 0x07, "12x"), (0x08, 0x08, "22x"), (0x09, 0x09, "32x"), (0x0A, 0x0D, "11x"), (0x0E, 0x0E, "10x"),
    (0x0F, 0x11, "11x"), (0x12, 0x12, "11n"), (0x13, 0x13, "21s"), (0x14, 0x14, "31i"), (0x15, 0x15, "21h"), (0x16, 0x16, "21s"),
    (0x17, 0x17, "31i"), (0x18, 0x18, "51l"), (0x19, 0x19, "21h"), (0x1A, 0x1A, "21c"), (0x1B, 0x1B, "31c"), (0x1C, 0x1C, "21c"),
    (0x1D, 0x1E, "11x"), (0x1F, 0x1F, "21c"), (0x20, 0x20, "22c"), (0x21, 0x21, "12x"), (0x22, 0x22, "21c"), (0x23, 0x23, "22c"),
    (0x24, 0x24, "35c"), (0x25, 0x25, "3rc"), (0x26, 0x26, "31t"), (0x27, 0x27, "11x"), (0x28, 0x28, "10t"), (0x29, 0x29, "20t"),
    (0x2A, 0x2A, "30t"), (0x2B, 0x2C, "31t"), (0x2D, 0x31, "23x"), (0x32, 0x37, "22t"), (0x38, 0x3D, "21t"), (0x44, 0x51, "23x"),
    (0x52, 0x5F, "22c"), (0x60, 0x6D, "21c"), (0x6E, 0x72, "35c"), (0x74, 0x78, "3rc"), (0x7B, 0x8F, "12x"), (0x90, 0xAF, "23x"),
    (0xB0, 0xCF, "12x"), (0xD0, 0xD7, "22s"), (0xD8, 0xE2, "22b"), (0xED, 0xED, "20bc"), (0xEE, 0xEE, "35mi"), (0xF0, 0xF0, "35c"),
    (0xF2, 0xF7, "22cs"), (0xF8, 0xF8, "35ms"), (0xF9, 0xF9, "3rms"), (0xFA, 0xFA, "45cc"), (0xFB, 0xFB, "4rcc"), (0xFC, 0xFC, "35c"),
    (0xFD, 0xFD, "3rc"), (0xFE, 0xFF, "21c"),
]

# First opcode, last opcode, kind of the index in unit 1.
REFERENCES = [
    (0x1A, 0x1B, "string"), (0x1C, 0x1C, "type"), (0x1F, 0x20, "type"), (0x22, 0x25, "type"), (0x52, 0x6D, "field"), (0x6E, 0x72, "method"),
    (0x74, 0x78, "method"), (0xFA, 0xFB, "method"), (0xFC, 0xFD, "call_site"), (0xFE, 0xFE, "method_handle"), (0xFF, 0xFF, "proto"),
]

# Names of the instructions in order, for each run of opcodes that the smali listing spells out.
_NAMES = {
    0x00: "nop move move/from16 move/16 move-wide move-wide/from16 move-wide/16 move-object move-object/from16 move-object/16 move-result move-result-wide move-result-object move-exception return-void return return-wide return-object const/4 const/16 const const/high16 const-wide/16 const-wide/32 const-wide const-wide/high16 const-string const-string/jumbo const-class monitor-enter monitor-exit check-cast instance-of array-length new-instance new-array filled-new-array filled-new-array/range fill-array-data throw goto goto/16 goto/32 packed-switch sparse-switch cmpl-float cmpg-float cmpl-double cmpg-double cmp-long if-eq if-ne if-lt if-ge if-gt if-le if-eqz if-nez if-ltz if-gez if-gtz if-lez",
    0x6E: "invoke-virtual invoke-super invoke-direct invoke-static invoke-interface",
    0x74: "invoke-virtual/range invoke-super/range invoke-direct/range invoke-static/range invoke-interface/range",
    0x7B: "neg-int not-int neg-long not-long neg-float neg-double int-to-long int-to-float int-to-double long-to-int long-to-float long-to-double float-to-int float-to-long float-to-double double-to-int double-to-long double-to-float int-to-byte int-to-char int-to-short",
    0xD0: "add-int/lit16 rsub-int mul-int/lit16 div-int/lit16 rem-int/lit16 and-int/lit16 or-int/lit16 xor-int/lit16 add-int/lit8 rsub-int/lit8 mul-int/lit8 div-int/lit8 rem-int/lit8 and-int/lit8 or-int/lit8 xor-int/lit8 shl-int/lit8 shr-int/lit8 ushr-int/lit8",
    0xFA: "invoke-polymorphic invoke-polymorphic/range invoke-custom invoke-custom/range const-method-handle const-method-type",
}


def _names() -> dict[int, str]:
    found = {first + i: name for first, names in _NAMES.items() for i, name in enumerate(names.split())}
    kinds = ["", "-wide", "-object", "-boolean", "-byte", "-char", "-short"]
    for first, verb in ((0x44, "aget"), (0x4B, "aput"), (0x52, "iget"), (0x59, "iput"), (0x60, "sget"), (0x67, "sput")):
        found |= {first + i: verb + kind for i, kind in enumerate(kinds)}
    whole = ["add", "sub", "mul", "div", "rem", "and", "or", "xor", "shl", "shr", "ushr"]
    ops = [f"{o}-{t}" for t in ("int", "long") for o in whole] + [f"{o}-{t}" for t in ("float", "double") for o in whole[:5]]
    found |= {0x90 + i: o for i, o in enumerate(ops)} | {0xB0 + i: f"{o}/2addr" for i, o in enumerate(ops)}
    return found


NAMES = _names()
FORMAT = {op: f for first, last, f in FORMATS for op in range(first, last + 1)}
#: The first digit of a format is its width.
WIDTH = {op: int(f[0]) for op, f in FORMAT.items()}
KIND = {op: k for first, last, k in REFERENCES for op in range(first, last + 1)}


def payload_units(insns: bytes, unit: int) -> int:
    """Width of the switch or array data at a unit, 0 where there is none."""
    first = u16(insns, unit * 2)
    if first == 0x0100:
        return 4 + 2 * u16(insns, unit * 2 + 2)
    if first == 0x0200:
        return 2 + 4 * u16(insns, unit * 2 + 2)
    if first == 0x0300:
        return 4 + (u16(insns, unit * 2 + 2) * u32(insns, unit * 2 + 4) + 1) // 2
    return 0


def instructions(insns: bytes):
    """(offset, opcode, width, is payload) of each instruction; a FormatError ends the walk where it can't go on."""
    at, end = 0, len(insns) // 2
    while at < end:
        width = payload_units(insns, at)
        payload = width > 0
        op = insns[at * 2]
        if not payload:
            width = WIDTH.get(op, 0)
            if not width:
                raise FormatError(f"unknown opcode {op:#04x} at unit {at}")
        if at + width > end:
            raise FormatError(f"instruction at unit {at} is cut off")
        yield at, op, width, payload
        at += width


def references(insns: bytes):
    """(offset, opcode, slot, kind, index) of each reference; slot 1 is the second one of invoke-polymorphic."""
    for at, op, _, payload in instructions(insns):
        kind = None if payload else KIND.get(op)
        if kind:
            yield at, op, 0, kind, (u32 if op == 0x1B else u16)(insns, at * 2 + 2)
            if op in (0xFA, 0xFB):
                yield at, op, 1, "proto", u16(insns, at * 2 + 6)
