"""Byte formats: what is written comes back, and broken bytes are reported rather than fatal."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dexlake.formats import arsc, axml, binary, dex, elf, hermes, opcodes, signing, synth, zip


@given(st.integers(0, (1 << 32) - 1))
def test_uleb_round_trip(n):
    assert binary.uleb(binary.put_uleb(n), 0) == (n, len(binary.put_uleb(n)))


@given(st.integers(-(1 << 31), (1 << 31) - 1))
def test_sleb_round_trip(n):
    assert binary.sleb(binary.put_sleb(n), 0)[0] == n


@given(st.text())
def test_mutf8_round_trip(text):
    assert binary.mutf8_text(binary.mutf8_bytes(text)) == text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    assert b"\0" not in binary.mutf8_bytes(text)


def test_mutf8_malformed_bytes_become_replacements():
    assert binary.mutf8_text(b"a\xffb") == "a�b"
    assert binary.mutf8_text(b"\xc0\x80") == "\0"


def test_instruction_widths_cover_the_known_opcodes():
    unknown = [op for op in range(256) if op not in opcodes.WIDTH]
    assert unknown == [*range(0x3E, 0x44), 0x73, 0x79, 0x7A, *range(0xE3, 0xED), 0xEF, 0xF1]
    assert opcodes.KIND[0x1B] == "string" and opcodes.WIDTH[0x1B] == 3


def test_payloads_are_stepped_over():
    switch = (0x0100).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes(8)
    body = bytes.fromhex("0e00") + bytes.fromhex("0000") + switch
    assert [x[3] for x in opcodes.instructions(body)] == [False, False, True]


def _classes():
    return [
        synth.Class("La/B;", interfaces=["La/I;"], source="B.java", fields=[("x", "I", 2, False), ("Y", "Ljava/lang/String;", 9, True)], methods=[
            synth.Method("run", body=[("string", "héllo 😀"), ("call", ("La/C;", "go", "(ILjava/lang/String;[J)V")), ("type", "La/C;"), ("field", ("La/C;", "f", "I"))]),
            synth.Method("nat", "(I)I", 0x101),
        ]),
        synth.Class("La/C;", parent="La/B;"),
    ]


@pytest.mark.parametrize("version", [b"035", b"037", b"038", b"039", b"040", b"041"])
def test_dex_round_trip(version):
    found = list(dex.rows(synth.build(_classes(), version=version), "classes.dex"))
    assert not [r for r in found if r[1] == "issue"]
    (view,) = [r[2] for r in found if r[1] == "dex"]
    assert view["checksum"] == view["adler"] and view["sha1_ok"] == 1
    assert {r[2]["descriptor"] for r in found if r[1] == "class_def"} == {"La/B;", "La/C;"}
    assert [r[2]["ref_kind"] for r in found if r[1] == "code_ref"] == ["string", "method", "type", "field"]
    assert "héllo 😀" in [r[2]["text"] for r in found if r[1] == "string"]
    assert [r[2]["signature"] for r in found if r[1] == "method" and r[2]["name"] == "go"] == ["(ILjava/lang/String;[J)V"]


def test_dex_with_a_wrong_version_or_checksum():
    assert next(dex.rows(synth.build(_classes(), version=b"036"), "x"))[2]["status"] == "failed"
    (view,) = [r[2] for r in dex.rows(synth.build(_classes(), checksum=7), "x") if r[1] == "dex"]
    assert view["checksum"] == 7 != view["adler"]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_damaged_dex_never_breaks_the_reader(data):
    raw = bytearray(synth.build(_classes()))
    for _ in range(data.draw(st.integers(1, 8))):
        raw[data.draw(st.integers(8, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = bytes(raw[: data.draw(st.integers(0, len(raw)))])
    try:
        for _ in dex.rows(raw, "x"):
            pass
    except binary.FormatError:
        pass


def test_zip_reads_what_was_written_and_notices_damage():
    raw = zip.write([("classes2.dex", b"two" * 50), ("classes.dex", b"one", 0), ("a/classes.dex", b"x"), ("classes.dex", b"again")])
    found = zip.entries(raw)
    assert [e.name for e in zip.dex_entries(found)] == ["classes.dex", "classes2.dex"]
    assert zip.read(raw, zip.dex_entries(found)[0], verify=True) == b"one"
    assert zip.prefix(raw, found[0], 4) == (b"twot", False)
    with pytest.raises(binary.FormatError):
        zip.entries(b"PK nothing")
    broken = bytearray(raw)
    broken[raw.index(zip.LOCAL)] = 0
    with pytest.raises(binary.FormatError):
        zip.read(bytes(broken), found[0])


MANIFEST = ("manifest", {":package": "a.b", "versionCode": 3}, [
    ("uses-sdk", {"minSdkVersion": 21, "targetSdkVersion": 33}, []), ("uses-permission", {"name": "X"}, []),
    ("application", {"debuggable": True}, [
        ("activity", {"name": ".Main"}, [("intent-filter", {}, [("action", {"name": "VIEW"}, []), ("data", {"scheme": "https", "host": "e.com"}, [])])]),
        ("provider", {"name": "P", "exported": False}, []), ("service", {"name": "c.S"}, []),
    ]),
])


def test_manifest_round_trip():
    m = axml.manifest(axml.write(MANIFEST))
    assert (m["package"], m["target_sdk"], m["debuggable"]) == ("a.b", 33, True)
    assert [(c["name"], c["exported_state"], c["effective_exported"]) for c in m["components"]] == [(".Main", "missing_required", True), ("P", "explicit", False), ("c.S", "legacy_inferred", False)]
    assert m["components"][0]["filters"][0]["data"][0]["host"] == "e.com"
    assert '<activity android:name=".Main">' in axml.xml_text(axml.nodes(axml.write(MANIFEST)))


def test_hermes_strings():
    assert [t for _, _, t in hermes.strings(hermes.write(["abc", "né", "", "x" * 300, "é" * 254]))] == ["abc", "né", "", "x" * 300, "é" * 254]
    with pytest.raises(binary.FormatError):
        list(hermes.strings(hermes.write(["a"], version=60)))


def test_jar_sections_join_continuation_lines():
    raw = b"Manifest-Version: 1.0\r\n\r\nName: a/b\r\n c\r\nSHA-256-Digest: q80=\r\n\r\n"
    sections = signing.jar_sections(raw)
    assert sections[1][0]["Name"] == "a/bc" and b"".join(s for _, s in sections) == raw
    assert signing.jar_digest(sections[1][0]) == ("sha256", b"\xab\xcd")


def test_der_lengths_and_names():
    assert signing.tlv(b"\x30\x82\x00\x01x") == (0x30, b"x", 5)
    assert signing.oid(bytes.fromhex("2a864886f70d01010b")) == "1.2.840.113549.1.1.11"


def test_adler_is_over_everything_behind_the_checksum():
    raw = synth.build(_classes())
    assert int.from_bytes(raw[8:12], "little") == zlib.adler32(raw[12:])


def test_resources_round_trip():
    found = list(arsc.resources(arsc.write("a.b", "string", [("one", "x"), ("two", "é😀")])))
    assert [(r["package"], r["res_id"], r["type"], r["key"], r["config"], r["text"]) for r in found] == [("a.b", 0x7F010000, "string", "one", "default", "x"), ("a.b", 0x7F010001, "string", "two", "default", "é😀")]


def test_libraries_export_and_register():
    lib = elf.Elf(elf.write(["Java_a", "Java_b"], [("go", "(ILa/B;[[J)Z"), ("no name", "()V"), ("x", "(V)V"), ("y", "()V")]))
    assert lib.machine == "aarch64" and lib.exports() == ["Java_a", "Java_b"]
    tables, notes = lib.jni_tables()
    assert [(n, s) for n, s, _ in tables] == [("go", "(ILa/B;[[J)Z"), ("y", "()V")] and not notes
    assert elf.Elf(elf.write(["a"])).jni_tables() == ([], [])
    broken = bytearray(elf.write([], [("go", "()V")]))
    for at in range(64, len(broken), 7):
        try:
            elf.Elf(bytes(broken[:at])).jni_tables()
        except binary.FormatError:
            pass


def test_packed_relocations():
    put = binary.put_sleb
    one = b"APS2" + put(3) + put(100) + put(2) + put(1 | 2 | 8) + put(8) + put(1027) + put(5) + put(-2) + put(1) + put(8) + put(4) + put(1025) + put(7)
    assert list(elf.unpacked(one, True, True)) == [(108, 1027, 5), (116, 1027, 3), (120, 1025, 10)]
    for bad in (b"APS1", one[:9], b"APS2" + put(1) + put(0) + put(2) + put(0), b"APS2" + put(1) + put(0) + put(1) + put(8) + put(1) + put(1) + put(1)):
        with pytest.raises(binary.FormatError):
            list(elf.unpacked(bad, True, False))
