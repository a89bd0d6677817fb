"""Reading little-endian numbers, variable-length numbers and modified UTF-8."""

from __future__ import annotations

import struct

NO_INDEX = 0xFFFFFFFF


class FormatError(ValueError):
    """Bytes that aren't what their format asks for."""


def u16(data: bytes, at: int) -> int:
    if at < 0 or at + 2 > len(data):
        raise FormatError(f"2 bytes at {at} are beyond the end")
    return data[at] | data[at + 1] << 8


def u32(data: bytes, at: int) -> int:
    if at < 0 or at + 4 > len(data):
        raise FormatError(f"4 bytes at {at} are beyond the end")
    return int.from_bytes(data[at : at + 4], "little")


def u64(data: bytes, at: int) -> int:
    if at < 0 or at + 8 > len(data):
        raise FormatError(f"8 bytes at {at} are beyond the end")
    return int.from_bytes(data[at : at + 8], "little")


def part(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise FormatError(f"{size} bytes at {at} are beyond the end")
    return data[at : at + size]


def uleb(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned variable-length number of at most five bytes, and what follows it."""
    value = 0
    for k in range(5):
        if at + k >= len(data):
            raise FormatError("a number is cut off")
        byte = data[at + k]
        value |= (byte & 0x7F) << 7 * k
        if byte < 0x80:
            if value > NO_INDEX:
                raise FormatError("a number has over 32 bits")
            return value, at + k + 1
    raise FormatError("a number has over five bytes")


def sleb(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for k in range(5):
        if at + k >= len(data):
            raise FormatError("a number is cut off")
        byte = data[at + k]
        value |= (byte & 0x7F) << 7 * k
        if byte < 0x80:
            bits = 7 * (k + 1)
            if byte & 0x40:
                value -= 1 << bits
            return (value + (1 << 31)) % (1 << 32) - (1 << 31), at + k + 1
    raise FormatError("a number has over five bytes")


def put_uleb(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def put_sleb(value: int) -> bytes:
    out = bytearray()
    while True:
        byte = value & 0x7F
        value >>= 7
        if value == (-1 if byte & 0x40 else 0):
            out.append(byte)
            return bytes(out)
        out.append(byte | 0x80)


def utf16_units(raw: bytes) -> list[int]:
    """UTF-16 code units of modified UTF-8; anything malformed is U+FFFD, one for each byte that can't begin or go on."""
    units: list[int] = []
    at, end = 0, len(raw)
    while at < end:
        a = raw[at]
        if a < 0x80:
            units.append(a)
            at += 1
        elif a & 0xE0 == 0xC0 and at + 1 < end and raw[at + 1] & 0xC0 == 0x80:
            units.append((a & 0x1F) << 6 | raw[at + 1] & 0x3F)
            at += 2
        elif a & 0xF0 == 0xE0 and at + 2 < end and raw[at + 1] & 0xC0 == 0x80 and raw[at + 2] & 0xC0 == 0x80:
            units.append((a & 0x0F) << 12 | (raw[at + 1] & 0x3F) << 6 | raw[at + 2] & 0x3F)
            at += 3
        else:
            units.append(0xFFFD)
            at += 1
    return units


def mutf8_text(raw: bytes) -> str:
    """Text of modified UTF-8: C0 80 is NUL, surrogate pairs are joined, lone ones and malformed bytes are U+FFFD."""
    if raw.isascii():
        return raw.decode("ascii")
    units = utf16_units(raw)
    return struct.pack(f"<{len(units)}H", *units).decode("utf-16-le", "replace")


def mutf8_bytes(text: str) -> bytes:
    """Modified UTF-8 of a text."""
    if text.isascii() and "\0" not in text:
        return text.encode("ascii")
    out = bytearray()
    raw = text.encode("utf-16-le", "surrogatepass")
    for (unit,) in struct.iter_unpack("<H", raw):
        if 0 < unit < 0x80:
            out.append(unit)
        elif unit < 0x800:
            out += bytes((0xC0 | unit >> 6, 0x80 | unit & 0x3F))
        else:
            out += bytes((0xE0 | unit >> 12, 0x80 | unit >> 6 & 0x3F, 0x80 | unit & 0x3F))
    return bytes(out)


def mutf8_end(data: bytes, at: int) -> int:
    end = data.find(b"\0", at)
    if end < 0:
        raise FormatError("a string has no end")
    return end
