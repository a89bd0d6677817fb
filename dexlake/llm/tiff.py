"""TIFF media columns: walk image directories and decode every page to samples.

:func:`pages_of` reads classic and big TIFF in either byte order, follows the chain of image directories (a directory
met twice ends the walk), decodes strips and tiles stored plain or with PackBits, LZW or deflate, undoes the
horizontal and the floating-point predictor, and yields one :class:`Page` per directory.  :func:`tiff_pages` is the
DataFrame form: one row per page.

Defined results: null or empty content has no rows; content that is no TIFF, or whose directory can't be
read, has one row with ``error`` set; a page with a broken strip or tile has its row with ``error`` set and no samples,
and the pages behind it are still read.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dexlake.llm.common import bounded_batches, by_rows, texts_of

# Fixed values of the TIFF 6.0 format: tags, compressions, byte widths of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_FORMATS = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class TiffError(ValueError):
    """The bytes are no TIFF, or a part of it can't be read."""


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 1
    compression: int = PLAIN
    predictor: int = 1
    layout: str = "strips"
    pixels: np.ndarray | None = None
    error: str | None = None


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a byte n below 128 is followed by n + 1 literals, one above by a byte repeated 257 - n times; 128 is skipped."""
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    """The PackBits form of ``data``: runs of three or more become repeats."""
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        nonlocal at
        while at < stop:
            piece = data[at : min(stop, at + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)
            at += len(piece)

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(m.start())
        out += bytes((257 - (m.end() - m.start()), data[at]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    out = bytearray()
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = start[:], 9, None
    hold, have = 0, 0
    for byte in data:
        hold, have = (hold << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = hold >> have
        hold &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = start[:], 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW data starts with a code that isn't defined")
            piece = table[code]
        else:
            if code < len(table):
                piece = table[code]
            elif code == len(table):
                piece = last + last[:1]
            else:
                raise TiffError("LZW code beyond the table")
            if len(table) < 4096:
                table.append(last + piece[:1])
                if len(table) + 1 in (512, 1024, 2048):
                    width += 1
        out += piece
        last = piece
        if len(out) >= size:
            break
    return bytes(out[:size])


def pack_lzw(data: bytes) -> bytes:
    """The LZW form of ``data`` that :func:`unpack_lzw` reads."""
    hold, have, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal hold, have
        hold, have = (hold << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(hold >> have)
            hold &= (1 << have) - 1

    codes = {bytes((i,)): i for i in range(256)}
    following, width = 258, 9
    put(256, width)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word], width)
        codes[longer] = following
        following += 1
        if following in (512, 1024, 2048):
            width += 1
        elif following == 4095:
            put(256, width)
            codes = {bytes((k,)): k for k in range(256)}
            following, width = 258, 9
        word = data[i : i + 1]
    if word:
        put(codes[word], width)
        if following in (511, 1023, 2047):  # the reader has defined one more code by now
            width += 1
    put(257, width)
    if have:
        out.append((hold << (8 - have)) & 255)
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


def _deflate(data: bytes) -> bytes:
    return zlib.compress(data, 1)


DECODERS = {PLAIN: lambda data, size: data[:size], PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
#: Bytes that a decoder makes of one stored byte at most: 258 of two bits for deflate, the longest string of a full table a byte for LZW.
MOST = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}
ENCODERS = {PLAIN: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: _deflate, OLD_DEFLATE: _deflate}


@dataclass
class _Directory:
    order: str
    fields: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default: int | None = None) -> int:
        got = self.fields.get(tag)
        if not got:
            if default is None:
                raise TiffError(f"field {tag} is missing")
            return default
        return int(got[0])


def _directories(data: bytes) -> Iterator[_Directory]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        at, count, word, entry = struct.unpack_from(order + "I", data, 4)[0], "H", "I", 12
    elif magic == 43 and len(data) >= 16:
        at, count, word, entry = struct.unpack_from(order + "Q", data, 8)[0], "Q", "Q", 20
    else:
        raise TiffError("no TIFF header")
    wide = struct.calcsize(order + word)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(order + count, data, at)[0]
            first = at + struct.calcsize(order + count)
            after = struct.unpack_from(order + word, data, first + n * entry)[0]
            found = _Directory(order)
            for p in range(first, first + n * entry, entry):
                tag, kind, many = struct.unpack_from(order + "HH" + word, data, p)
                form = TYPE_FORMATS.get(kind)
                if form is None:
                    continue
                spell = f"{order}{many * len(form)}{form[0]}"
                value = p + entry - wide
                if struct.calcsize(spell) > wide:
                    value = struct.unpack_from(order + word, data, value)[0]
                if struct.calcsize(spell) > len(data):
                    raise TiffError(f"field {tag} is longer than the file")
                found.fields[tag] = struct.unpack_from(spell, data, value)
        except struct.error as e:
            raise TiffError(f"image directory at {at}: {e}") from e
        yield found
        at = after


def _undo(block: np.ndarray, predictor: int, order: str, bits: int) -> np.ndarray:
    """block: rows x columns x samples, as stored; in native byte order if all is well."""
    rows, columns, samples = block.shape
    if predictor == 2:
        if bits not in (8, 16, 32, 64):
            raise TiffError(f"horizontal predictor on {bits} bits")
        return np.cumsum(block.astype(f"u{bits // 8}"), axis=1, dtype=f"u{bits // 8}")
    if predictor == 3:
        wide = bits // 8
        raw = np.ascontiguousarray(block).astype(block.dtype.newbyteorder(order)).view(np.uint8).reshape(rows, -1)
        summed = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, wide, columns * samples)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">u{wide}").reshape(rows, columns, samples).astype(f"u{wide}")
    if predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return block


def _block(raw: bytes, rows: int, columns: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    if bits in (8, 16, 32, 64):
        kind = np.dtype(f"{order}u{bits // 8}")
        need = rows * columns * samples * kind.itemsize
        if len(raw) < need:
            raise TiffError(f"{len(raw)} bytes of {need}")
        block = np.frombuffer(raw, kind, rows * columns * samples).reshape(rows, columns, samples)
        return _undo(block.astype(kind.newbyteorder("=")), predictor, order, bits)
    if bits not in (1, 2, 4):
        raise TiffError(f"{bits} bits a sample")
    stride = -(-columns * samples * bits // 8)
    if len(raw) < rows * stride:
        raise TiffError(f"{len(raw)} bytes of {rows * stride}")
    lines = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride), axis=1)
    lines = lines[:, : columns * samples * bits].reshape(rows, columns, samples, bits)
    return _undo((lines << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8), predictor, order, bits)


def _decode(data: bytes, d: _Directory, page: Page) -> None:
    page.width, page.height = d.one(WIDTH), d.one(HEIGHT)
    page.samples, page.compression, page.predictor = d.one(SAMPLES, 1), d.one(COMPRESSION, 1), d.one(PREDICTOR, 1)
    depths = {int(x) for x in d.fields.get(BITS, (1,))}
    page.bits = max(depths)
    page.layout = "tiles" if TILE_OFFSETS in d.fields else "strips"
    if len(depths) > 1:
        raise TiffError("samples of several widths")
    decoder = DECODERS.get(page.compression)
    if decoder is None:
        raise TiffError(f"compression {page.compression}")
    if page.layout == "tiles":
        across, down = d.one(TILE_WIDTH), d.one(TILE_HEIGHT)
        offsets, sizes = d.fields[TILE_OFFSETS], d.fields.get(TILE_BYTES, ())
    else:
        across, down = page.width, min(d.one(ROWS_PER_STRIP, page.height), page.height) or 1
        offsets, sizes = d.fields.get(STRIP_OFFSETS, ()), d.fields.get(STRIP_BYTES, ())
    if not across or not down or len(offsets) != len(sizes):
        raise TiffError("strips or tiles without a size")
    planes, deep = (page.samples, 1) if d.one(PLANAR, 1) == 2 else (1, page.samples)
    columns, lines = -(-page.width // across), -(-page.height // down)
    if len(offsets) < planes * columns * lines:
        raise TiffError("strips or tiles are missing")
    kind = f"u{max(1, page.bits // 8)}"
    packed = planes * columns * (lines * down if page.layout == "tiles" else page.height) * -(-across * deep * page.bits // 8)
    stored = sum(max(0, min(size, len(data) - at)) for at, size in zip(offsets[: planes * columns * lines], sizes, strict=False))
    if packed > max(1 << 16, MOST[page.compression] * stored):
        raise TiffError("more samples than the file can hold")
    pixels = np.zeros((page.height, page.width, page.samples), kind)
    for k in range(planes * columns * lines):
        plane, cell = divmod(k, columns * lines)
        top, left = cell // columns * down, cell % columns * across
        rows = down if page.layout == "tiles" else min(down, page.height - top)
        raw = data[offsets[k] : offsets[k] + sizes[k]]
        if d.one(FILL_ORDER, 1) == 2:
            raw = raw.translate(REVERSED)
        try:
            raw = decoder(raw, rows * (-(-across * deep * page.bits // 8)))
        except zlib.error as e:
            raise TiffError(str(e)) from e
        block = _block(raw, rows, across, deep, page.bits, d.order, page.predictor)
        part = block[: page.height - top, : page.width - left]
        pixels[top : top + part.shape[0], left : left + part.shape[1], plane : plane + deep] = part
    page.pixels = pixels


def pages_of(data: bytes | None) -> Iterator[Page]:
    """The pages of a TIFF, in the order of their directories."""
    if not data:
        return
    number = 0
    try:
        for d in _directories(data):
            page = Page(number)
            number += 1
            try:
                _decode(data, d, page)
            except (TiffError, struct.error, KeyError, ValueError, OverflowError) as e:
                page.error = str(e) or type(e).__name__
            yield page
    except TiffError as e:
        yield Page(number, error=str(e))


def write_tiff(images: Sequence[dict], order: str = "<") -> bytes:
    """A classic TIFF of ``images``: each has ``pixels`` (rows x columns [x samples], uint8 or uint16), and may have
    ``compression``, ``predictor`` (1 or 2), ``tile`` (width, height; multiples of 16) or ``rows_per_strip``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        pixels = image["pixels"]
        pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
        height, width, samples = pixels.shape
        bits = pixels.dtype.itemsize * 8
        compression, predictor, tile = image.get("compression", PLAIN), image.get("predictor", 1), image.get("tile")
        across, down = tile or (width, image.get("rows_per_strip", height))
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = pixels[top : top + down, left : left + across]
                if tile and block.shape[:2] != (down, across):
                    whole = np.zeros((down, across, samples), block.dtype)
                    whole[: block.shape[0], : block.shape[1]] = block
                    block = whole
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                packed = ENCODERS[compression](block.astype(block.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        fields = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bits] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [samples]), (PREDICTOR, "H", [predictor])]
        if tile:
            fields += [(TILE_WIDTH, "I", [across]), (TILE_HEIGHT, "I", [down]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", sizes)]
        else:
            fields += [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [down]), (STRIP_BYTES, "I", sizes)]
        entries = b""
        for tag, form, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                where = struct.pack(order + "I", len(out))
                out += packed
            else:
                where = packed.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + where
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def tiff_pages(df: DataFrame, *, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """One row per page of every TIFF in ``content_col``: its shape, how it was stored, its samples as bytes
    (row by row, samples of a pixel together, little-endian) and ``error``."""
    bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, page int, width long, height long, samples int, bits int, compression int, predictor int, layout string, pixels binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0).slice(i, 1)
                for p in pages_of(batch.column(1)[i].as_py()):
                    pixels = None if p.pixels is None else p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                    row = [(p.page, pa.int32()), (p.width, pa.int64()), (p.height, pa.int64()), (p.samples, pa.int32()), (p.bits, pa.int32()), (p.compression, pa.int32()), (p.predictor, pa.int32()), (p.layout, pa.string()), (pixels, pa.binary()), (p.error, pa.string())]
                    names = [id_col, "page", "width", "height", "samples", "bits", "compression", "predictor", "layout", "pixels", "error"]
                    yield pa.RecordBatch.from_arrays([key, *(pa.array([v], t) for v, t in row)], names=names)

    return df.select(id_col, content_col).mapInArrow(run, schema)


ROW_BYTES = 576
TAIL_SIDE, TILE_SIDE = 24, 32
STRIP_ROWS = 64


def text_to_tiff(payload: bytes) -> bytes:
    """``payload``, a positive multiple of 576 bytes, as 8-bit samples: the last 576 on a page of 24 x 24 in a PackBits
    tile, all before them on a page 576 wide in deflated strips under the horizontal predictor."""
    samples = np.frombuffer(payload, np.uint8)
    images = []
    if len(payload) > ROW_BYTES:
        images.append({"pixels": samples[:-ROW_BYTES].reshape(-1, ROW_BYTES), "compression": DEFLATE, "predictor": 2, "rows_per_strip": STRIP_ROWS})
    images.append({"pixels": samples[-ROW_BYTES:].reshape(TAIL_SIDE, TAIL_SIDE), "compression": PACKBITS, "tile": (TILE_SIDE, TILE_SIDE)})
    return write_tiff(images)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, with bytes 255 up to a positive multiple of 576, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES - len(raw)), len(raw)


def feature_of(pages: Sequence[Page]) -> str:
    """Page count, mean sample (millionths), and a histogram of 16 brightness classes over all pages."""
    counts = np.bincount(np.concatenate([p.pixels.ravel() for p in pages]) if len(pages) > 1 else pages[0].pixels.ravel(), minlength=256)
    total = int(counts.sum())
    mean = int((counts * np.arange(256)).sum()) * 1_000_000 // max(1, total)
    return f"pages={len(pages)};mean={mean};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))


def text_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a TIFF, decode its pages again, and return digests of what was read back.

    A narrow pass, one text in memory at a time.  Null is the empty text: one page of 576 bytes 255.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def digests(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")}
        for text in texts_of(batch.column(1)):
            payload, n = payload_of(text)
            media = text_to_tiff(payload)
            pages = list(pages_of(media))
            if broken := [p.error for p in pages if p.error]:
                raise TiffError(broken[0])
            back = b"".join(p.pixels.tobytes() for p in pages)
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pages), len(pages))
            for k, v in zip(made, row, strict=True):
                made[k].append(v)
        return {id_col: batch.column(0), **made}

    schema = f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return by_rows(df.select(id_col, text_col), digests, schema)
