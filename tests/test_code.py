"""Listings, control flow and hidden strings."""

import pytest
from pyspark.sql import functions as F

from dexlake.formats import synth
from dexlake.operators import deobfuscate, disasm
from dexlake.sources.artifacts import Catalog, wide_records


@pytest.fixture(scope="module")
def catalog(spark):
    # const/4 v0, 1; if-eqz v0, +3; nop; goto -1; const-string v0, "x"; return-void (added)
    body = [("raw", [0x1012, 0x0038, 0x0004, 0x0000, 0xFF28]), ("string", 'say "x"')]
    raw = synth.build([synth.Class("La/B;", methods=[synth.Method("run", body=body)])])
    frame = spark.createDataFrame([("one", "one.dex", bytearray(raw))], "aid string, path string, content binary")
    return Catalog(wide_records(frame).cache())


def test_listing(catalog):
    (row,) = disasm.listing(catalog, "a.B").collect()
    assert row["text"].startswith(".method public run()V\n") and row["text"].endswith(".end method")
    assert '    const-string v0, "say \\"x\\""' in row["text"] and ":l_3" in row["text"] and "goto :l_3" in row["text"]


def test_blocks_and_edges(catalog):
    insns = disasm.instruction_rows(catalog.table("code_item"))
    made, edges = disasm.blocks(insns)
    # const/4 and if-eqz, nop that both branches of the loop aim at, goto, then the rest
    assert sorted((r["block"], r["start"], r["end"], r["flow"]) for r in made.collect()) == [(0, 0, 3, "if"), (1, 3, 5, "goto"), (2, 5, 8, "return")]
    found = {(r["from"], r["to"], r["kind"]) for r in edges.collect()}
    assert (0, 1, "next") in found and any(k == "branch" for _, _, k in found)
    assert made.agg(F.sum("instructions")).first()[0] == insns.where("not payload").count()


def test_hidden_strings_come_back(spark):
    texts = ["hello", "", "😀é", "x" * 9000]
    ids, chunks = deobfuscate.hide(texts)
    assert [deobfuscate.reveal(i, chunks) for i in ids] == texts and deobfuscate.reveal(99, chunks) is None
    signed = [i - (1 << 64) if i >> 63 else i for i in ids]
    frame = spark.createDataFrame([(k, n, [[ord(u) for u in c] for c in chunks]) for k, n in enumerate(signed)], "k int, id long, chunks array<array<int>>")
    got = frame.withColumn("text", deobfuscate.revealed(F.col("id"), F.col("chunks"))).orderBy("k").collect()
    assert [r["text"] for r in got] == texts
    hits = spark.createDataFrame([("m", ["a"])], "caller string, matched array<string>")
    more = deobfuscate.with_revealed(hits, spark.createDataFrame([("m", "b"), ("m", "a")], "caller string, text string"), ["caller"])
    assert more.first()["matched_text"] == "a; b"


def test_rebuilt_class_has_the_same_code_and_no_other_class(spark):
    from dexlake.formats import dex, synth
    from dexlake.operators import rebuild

    code = synth.Code(3, 1, 1, bytes.fromhex("1a000000" "6e1000000000" "0d00" "0e00"), [(1, "string", "zz", 2), (3, "method", ("La/C;", "go", "()V"), 2)], [(0, 2, [("La/E;", 5), (None, 6)])])
    classes = [synth.Class("La/A;", methods=[synth.Method("x", body=[("string", "only here")])]), synth.Class("La/B;", fields=[("f", "I", 1, False)], interfaces=["La/I;"], source="B.java", methods=[synth.Method("run", code=code), synth.Method("abs", "(J)I", 0x401)])]
    whole = synth.build(classes)
    small = rebuild.rebuilt(whole, "La/B;")
    assert rebuild.rebuilt(whole, "La/No;") is None and len(small) < len(whole)

    def shown(raw):
        d = dex.Dex(raw)
        c = rebuild.class_of(d, "La/B;")
        return c.descriptor, c.parent, c.interfaces, c.source, c.fields, [(m.name, m.signature, m.flags, m.code and (m.code.references, m.code.tries)) for m in c.methods]

    assert shown(small) == shown(whole)
    found = list(dex.rows(small, "x"))
    assert not [r for r in found if r[1] == "issue"] and "only here" not in [r[2].get("text") for r in found if r[1] == "string"]
    assert [r[2]["sha1_ok"] for r in found if r[1] == "dex"] == [1]
    frame = spark.createDataFrame([("one", bytearray(whole)), ("two", bytearray(b"x"))], "aid string, content binary")
    got = {r["aid"]: r for r in rebuild.rebuilt_classes(frame, "La/B;").collect()}
    assert got["one"]["content"] == small and got["two"]["error"]


def test_decoders_are_found_and_their_calls_resolved(spark):
    """A class that keeps its chunks in a static array, and callers: with constants, over a branch, with a register touched in between."""
    texts = ["secret", "zwei", "\U0001f600 three"]
    ids, chunks = deobfuscate.hide(texts)
    assert len(chunks) == 1
    chunks = [chunks[0][i : i + deobfuscate.CHUNK_LENGTH] for i in range(0, len(chunks[0]), deobfuscate.CHUNK_LENGTH)]
    array, text, box = "[Ljava/lang/String;", "Ljava/lang/String;", ("Lq/D;", "c", "[Ljava/lang/String;")
    # const/4 v0, 1; new-array v0, v0; const/4 v1, 0; const-string v2; aput-object v2, v0, v1; sput-object v0; return-void
    start = synth.Code(3, 0, 0, bytes.fromhex("1210" "23000000" "1201" "1a020000" "4d020001" "69000000" "0e00"), [(2, "type", array, 2), (5, "string", chunks[0], 2), (9, "field", box, 2)])
    # sget-object v0; const-wide v1, multiplier; const/4 v0, 0; return-object v0
    seed = deobfuscate.SEED_MULTIPLIERS[0].to_bytes(8, "little").hex()
    get = synth.Code(5, 2, 0, bytes.fromhex("62000000" "1801" + seed + "1200" "1100"), [(1, "field", box, 2)])

    def caller(name, number, before="", between=""):
        # [before]; const-wide v0, number; [between]; invoke-static {v0, v1}, get; move-result-object v0; return-void
        head = bytes.fromhex(before) + bytes.fromhex("1800") + (number & (1 << 64) - 1).to_bytes(8, "little") + bytes.fromhex(between)
        return synth.Method(name, flags=9, virtual=False, code=synth.Code(4, 0, 2, head + bytes.fromhex("71200000" "1000" "0c00" "0e00"), [(len(head) // 2 + 1, "method", ("Lq/D;", "get", f"(J){text}"), 2)]))

    callers = [caller(f"m{k}", i) for k, i in enumerate(ids)]
    callers += [caller("touched", ids[0], between="1211"), caller("jumped", ids[0], before="38020700", between="0000"), caller("beside", ids[1], between="1203")]
    raw = synth.build([
        synth.Class("Lq/D;", fields=[("c", array, 9, True)], methods=[synth.Method("<clinit>", flags=0x10008, virtual=False, code=start), synth.Method("get", f"(J){text}", 9, virtual=False, code=get)]),
        synth.Class("Lq/Use;", methods=callers),
        synth.Class("Lq/No;", fields=[("c", array, 9, True)], methods=[synth.Method("get", f"(J){text}", 9, virtual=False, body=[("string", "no decoder")])]),
    ])
    catalog = Catalog(wide_records(spark.createDataFrame([("one", "one.dex", bytearray(raw))], "aid string, path string, content binary")).cache())
    assert not catalog.table("issue").collect()
    found = deobfuscate.decoders(catalog).cache()
    assert [(r["class_descriptor"], r["name"]) for r in found.collect()] == [("Lq/D;", "get")]
    from dexlake.operators.dexquery import owners

    calls = deobfuscate.decoded_calls(catalog, found).join(owners(catalog), ["aid", "dx", "code_off"])
    got = sorted((r["name"], r["text"]) for r in calls.select("name", "text").collect())
    assert got == [("beside", "zwei"), ("m0", "secret"), ("m1", "zwei"), ("m2", "\U0001f600 three")]
