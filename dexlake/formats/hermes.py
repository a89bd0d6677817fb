"""Strings of Hermes bytecode bundles."""

from __future__ import annotations

from collections.abc import Iterator

from dexlake.formats.binary import FormatError, part, u32

# Fixed values of the format.
MAGIC = bytes.fromhex("c61fbc03c103191f")
HEADER, FUNCTION, HASH, SMALL, OVERFLOW = 128, 16, 4, 4, 8
MOST_STRINGS, LONGEST = 4_000_000, 1 << 20


def version_of(head: bytes) -> int | None:
    return u32(head, 8) if head[:8] == MAGIC and len(head) >= 12 else None


def supported(version: int | None) -> bool:
    return version == 59 or version is not None and 74 <= version <= 96


def strings(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(index, string or identifier, text) of a bundle's string table."""
    version = version_of(data)
    if not supported(version):
        raise FormatError(f"bytecode version {version} isn't supported")
    functions, kinds, names, count, over, size = (u32(data, at) for at in range(40, 64, 4))
    if count > MOST_STRINGS:
        raise FormatError(f"{count} strings")
    runs = HEADER + functions * FUNCTION
    small = runs + kinds * 4 + names * HASH
    overflow = small + count * SMALL
    storage = overflow + over * OVERFLOW
    part(data, storage, size)
    bits = 30 if version == 59 else 31
    what: list[str] = []
    for k in range(kinds):
        run = u32(data, runs + 4 * k)
        what += ["identifier" if run >> bits else "string"] * (run & (1 << bits) - 1)
        if len(what) > count:
            raise FormatError("string kinds are longer than the table")
    for i in range(count):
        entry = u32(data, small + SMALL * i)
        wide, off, length = entry & 1, entry >> 1 & 0x7FFFFF, entry >> 24
        if length == 0xFF:
            off, length = u32(data, overflow + OVERFLOW * off), u32(data, overflow + OVERFLOW * off + 4)
        n = length * (2 if wide else 1)
        if off + n > size:
            raise FormatError(f"string {i} is beyond the storage")
        raw = part(data, storage + off, min(n, LONGEST))
        text = raw.decode("utf-16-le" if wide else "utf-8", "replace") + ("…" if n > LONGEST else "")
        yield i, what[i] if i < len(what) else "unknown", text


def write(texts: list[str], version: int = 96) -> bytes:
    """A bundle with a string table and nothing else; ``fileLength`` is its size."""
    n = lambda v: v.to_bytes(4, "little")
    small, over, storage = b"", b"", b""
    for t in texts:
        wide = not t.isascii()
        raw = t.encode("utf-16-le", "surrogatepass") if wide else t.encode()
        length = len(raw) // 2 if wide else len(raw)
        if length < 0xFF and len(storage) <= 0x7FFFFF:
            small += n(int(wide) | len(storage) << 1 | length << 24)
        else:
            small += n(int(wide) | len(over) // OVERFLOW << 1 | 0xFF << 24)
            over += n(len(storage)) + n(length)
        storage += raw
    kinds = n(len(texts)) if texts else b""
    body = kinds + small + over + storage
    head = MAGIC + n(version) + bytes(20) + n(HEADER + len(body)) + bytes(4) + b"".join(map(n, (0, len(kinds) // 4, 0, len(texts), len(over) // OVERFLOW, len(storage))))
    return head.ljust(HEADER, b"\0") + body
