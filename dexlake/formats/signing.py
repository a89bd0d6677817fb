"""Signing of packages: the signing block, DER, certificates, and JAR manifests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from dexlake.formats.binary import FormatError, part, u32, u64

# Fixed values of the formats.
BLOCK_MAGIC = b"APK Sig Block 42"
PAIR_KINDS = {0x7109871A: "v2", 0xF05368C0: "v3", 0x1B93AD61: "v3.1", 0x42726577: "padding", 0x504B4453: "dependency-info", 0x71777777: "source-stamp-v1", 0x6DFF800D: "source-stamp-v2"}
ALGORITHMS = {0x0101: ("rsa-pss", "sha256"), 0x0102: ("rsa-pss", "sha512"), 0x0103: ("rsa-pkcs1", "sha256"), 0x0104: ("rsa-pkcs1", "sha512"), 0x0201: ("ecdsa", "sha256"), 0x0202: ("ecdsa", "sha512"), 0x0301: ("dsa", "sha256"), 0x0421: ("verity", "sha256")}
OIDS = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "1.2.840.113549.1.1.1": "RSA", "1.2.840.113549.1.1.11": "SHA256withRSA", "1.2.840.113549.1.1.5": "SHA1withRSA", "1.2.840.10045.2.1": "EC", "1.2.840.10045.4.3.2": "SHA256withECDSA"}
CHUNK = 1 << 20


def block_pairs(data: bytes, central: int) -> list[tuple[int, bytes]]:
    """(id, value) pairs of the signing block in front of the central directory; none where there is no block."""
    if central < 32 or data[central - 16 : central] != BLOCK_MAGIC:
        return []
    size = u64(data, central - 24)
    start = central - size - 8
    if start < 0 or u64(data, start) != size:
        raise FormatError("the two sizes of the signing block differ")
    found, at, end = [], start + 8, central - 24
    while at < end:
        n = u64(data, at)
        if n < 4 or at + 8 + n > end:
            raise FormatError("a pair of the signing block is too long")
        found.append((u32(data, at + 8), part(data, at + 12, n - 4)))
        at += 8 + n
    return found


def block_start(data: bytes, central: int) -> int:
    return central - u64(data, central - 24) - 8


def _sized(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        n = u32(raw, at)
        yield part(raw, at + 4, n)
        at += 4 + n


def signers(value: bytes, v3: bool) -> Iterator[dict]:
    """Digests, certificates and signatures of each signer of a v2 or v3 block."""
    for signer in _sized(next(_sized(value), b"")):
        signed, rest = part(signer, 4, u32(signer, 0)), signer[4 + u32(signer, 0) :]
        fields = _sized(signed)
        digests = [(u32(d, 0), part(d, 8, u32(d, 4))) for d in _sized(next(fields, b""))]
        certs = list(_sized(next(fields, b"")))
        low = high = None
        if v3:
            low, high, rest = u32(rest, 0), u32(rest, 4), rest[8:]
        fields = _sized(rest)
        signatures = [(u32(s, 0), part(s, 8, u32(s, 4))) for s in _sized(next(fields, b""))]
        yield {"signed": signed, "digests": digests, "certs": certs, "signatures": signatures, "public_key": next(fields, b""), "min_sdk": low, "max_sdk": high}


def content_digest(data: bytes, start: int, central: int, end: int, algorithm: str) -> bytes:
    """The chunked digest over everything but the signing block; the end record counts as if the directory began where the block does."""
    tail = bytearray(data[end:])
    tail[16:20] = start.to_bytes(4, "little")
    chunks = [section[at : at + CHUNK] for section in (data[:start], data[central:end], bytes(tail)) for at in range(0, len(section), CHUNK)]
    whole = hashlib.new(algorithm, b"\x5a" + len(chunks).to_bytes(4, "little"))
    for c in chunks:
        whole.update(hashlib.new(algorithm, b"\xa5" + len(c).to_bytes(4, "little") + c).digest())
    return whole.digest()


def tlv(raw: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """Tag, content and end of a DER item."""
    tag, n, at = part(raw, at, 1)[0], part(raw, at + 1, 1)[0], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k < 5:
            raise FormatError("length of a DER item")
        n, at = int.from_bytes(part(raw, at, k)), at + k
    return tag, part(raw, at, n), at + n


def items(raw: bytes) -> list[tuple[int, bytes]]:
    found, at = [], 0
    while at < len(raw):
        tag, content, at = tlv(raw, at)
        found.append((tag, content))
    return found


def oid(raw: bytes) -> str:
    if not raw:
        raise FormatError("an empty object identifier")
    numbers, n = [], 0
    for b in raw:
        n = n << 7 | b & 0x7F
        if b < 0x80:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def _name(raw: bytes) -> str:
    words = []
    for _, rdn in items(raw):
        for _, pair in items(rdn):
            (_, kind), (tag, value) = items(pair)[:2]
            text = value.decode("utf-16-be" if tag == 30 else "utf-8", "replace")
            words.append(f"{OIDS.get(oid(kind), oid(kind))}={text}")
    return ", ".join(words)


def _time(tag: int, raw: bytes) -> str:
    """A DER time as text: years of two digits are 1950 to 2049."""
    t = raw.decode("ascii", "replace")
    if tag == 23:
        t = ("19" if t[:2] >= "50" else "20") + t
    return f"{t[:4]}-{t[4:6]}-{t[6:8]} {t[8:10]}:{t[10:12]}:{t[12:14]}Z"


def certificate(der: bytes) -> dict:
    """Subject, issuer, serial, validity, algorithms and fingerprints of an X.509 certificate."""
    body = items(tlv(tlv(der)[1])[1])
    if body and body[0][0] == 0xA0:
        body = body[1:]
    (_, serial), (_, algorithm), (_, issuer), (_, validity), (_, subject), (_, key) = body[:6]
    start, end = items(validity)[:2]
    algorithms = [oid(items(x)[0][1]) for x in (algorithm, items(key)[0][1])]
    return {"subject": _name(subject), "issuer": _name(issuer), "serial": serial.hex(), "not_before": _time(*start), "not_after": _time(*end), "signature_algorithm": OIDS.get(algorithms[0], algorithms[0]), "key_algorithm": OIDS.get(algorithms[1], algorithms[1]), "sha256": hashlib.sha256(der).hexdigest(), "sha1": hashlib.sha1(der).hexdigest()}


def pkcs7_certificates(der: bytes) -> list[bytes]:
    """Certificates of a signed-data message."""
    content = items(tlv(der)[1])
    signed = items(tlv(content[1][1])[1])
    found = []
    for tag, value in signed:
        if tag == 0xA0:
            at = 0
            while at < len(value):
                end = tlv(value, at)[2]
                found.append(value[at:end])
                at = end
    return found


def jar_sections(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Sections of a JAR manifest with their exact bytes; lines may go on behind a leading space and end in any way."""
    found: list[tuple[dict[str, str], bytes]] = []
    fields: list[tuple[str, str]] = []
    start = at = 0
    while at <= len(raw):
        ends = [e for e in (raw.find(b"\r", at), raw.find(b"\n", at)) if e >= 0]
        stop = min(ends, default=len(raw))
        line = raw[at:stop].decode("utf-8", "replace")
        after = stop + (2 if raw[stop : stop + 2] == b"\r\n" else 1)
        if line.startswith(" ") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + line[1:])
        elif line:
            key, _, value = line.partition(": ")
            fields.append((key, value))
        if not line and fields:
            found.append((dict(fields), raw[start : min(after, len(raw))]))
            fields = []
        if not line:
            start = after
        at = after
    return found


def jar_digest(section: dict[str, str]) -> tuple[str, bytes] | None:
    """The strongest digest that a section names."""
    for name, algorithm in (("SHA-512-Digest", "sha512"), ("SHA-384-Digest", "sha384"), ("SHA-256-Digest", "sha256"), ("SHA1-Digest", "sha1"), ("SHA-1-Digest", "sha1")):
        if name in section:
            text = section[name]
            if any(c.isspace() for c in text):
                return None
            try:
                return algorithm, base64.b64decode(text + "=" * (-len(text) % 4))
            except ValueError:
                return None
    return None
