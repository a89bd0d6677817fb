"""Artifacts through the catalog and every operator over it."""

import pytest
from pyspark.sql import functions as F

from dexlake.formats import axml, hermes, synth, zip
from dexlake.operators import artifacts as A
from dexlake.operators import dexquery as Q
from dexlake.operators import mapping
from dexlake.sources.artifacts import Catalog, read_artifacts, wide_records
from dexlake.streaming import ingest
from tests.test_formats import MANIFEST


def apk():
    one = synth.build([
        synth.Class("La/b/Main;", interfaces=["La/I;"], methods=[
            synth.Method("run", body=[("string", "https://x"), ("string", "plain"), ("call", ("La/b/Util;", "go", "()V")), ("call", ("La/b/Util;", "go", "()V"))]),
            synth.Method("nat", "(I)V", 0x101),
        ]),
        synth.Class("La/b/Util;", methods=[synth.Method("go", body=[("call", ("La/b/Main;", "run", "()V")), ("string", "https://y")], virtual=False)]),
    ])
    two = synth.build([synth.Class("La/b/Sub;", parent="La/b/Main;"), synth.Class("La/b/SubSub;", parent="La/b/Sub;")])
    return zip.write([("AndroidManifest.xml", axml.write(MANIFEST)), ("classes2.dex", two), ("classes.dex", one), ("assets/index.android.bundle", hermes.write(["hello", "wörld"]))])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("apks")
    (d / "one.apk").write_bytes(apk())
    (d / "bad.apk").write_bytes(b"nothing")
    (d / "all.xapk").write_bytes(zip.write([("base.apk", apk(), 0), ("manifest.json", b"{}")]))
    return d


@pytest.fixture(scope="module")
def files(spark, folder):
    return read_artifacts(spark, str(folder), "*.apk").cache()


@pytest.fixture(scope="module")
def catalog(files, tmp_path_factory):
    return Catalog.write(files, str(tmp_path_factory.mktemp("catalog") / "c"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_find_refs(catalog):
    hits = Q.find_refs(catalog, "string", "https://")
    assert rows(hits, "caller", "matched_text") == [("La/b/Main;->run", "https://x"), ("La/b/Util;->go", "https://y")]
    assert rows(Q.find_refs(catalog, "method", "go"), "caller", "matched_text") == [("La/b/Main;->run", "La/b/Util;->go")]
    assert rows(Q.find_refs(catalog, "method", class_pattern="a.b.Main"), "caller") == [("La/b/Util;->go",)]
    assert rows(Q.find_refs(catalog, "method", "go", class_pattern="Util", fuzzy_class=True), "caller") == [("La/b/Main;->run",)]
    assert Q.find_refs(catalog, "string", "").isEmpty() and Q.find_refs(catalog, "method", "go", class_pattern="", fuzzy_class=True).isEmpty()
    report = rows(Q.search_report(hits, catalog.table("dex")), "dex_name", "matched_methods")
    assert report == [("classes.dex", 2), ("classes2.dex", 0)]
    assert [r[0] for r in Q.report_lines(hits, catalog.table("dex")).collect()][0].startswith("classes.dex | La/b/")


def test_listings(catalog):
    assert rows(Q.list_classes(catalog, "a.b.S"), "descriptor") == [("La/b/Sub;",), ("La/b/SubSub;",)]
    assert rows(Q.class_counts(catalog, "a.b.S"), "dex_name", "classes") == [("classes.dex", 0), ("classes2.dex", 2)]
    assert rows(Q.list_methods(catalog, "a.b.Main", "NAT"), "overload", "flags") == [("nat(I)V", "public native")]
    assert rows(Q.class_strings(catalog, "a.b.Main"), "text", "sites") == [("https://x", 1), ("plain", 1)]
    assert Q.list_strings(catalog, "https", 1).first()["truncated"]


def test_graphs(catalog):
    assert rows(Q.subclasses(catalog, "a.b.Main"), "node", "depth") == [("La/b/Sub;", 1), ("La/b/SubSub;", 2)]
    assert rows(Q.subclasses(catalog, "a.b.Main", transitive=False), "node") == [("La/b/Sub;",)]
    assert rows(Q.implementers(catalog, "a.I"), "node", "depth") == [("La/b/Main;", 1), ("La/b/Sub;", 2), ("La/b/SubSub;", 3)]
    aid = catalog.table("class_def").first()["aid"]
    tree = rows(Q.call_tree(catalog, aid, "a.b.Main", "run", depth=3), "depth", "callee", "sites")
    assert tree == [(1, "La/b/Util;->go", 2), (2, "La/b/Main;->run", 1), (3, "La/b/Util;->go", 2)]
    assert Q.call_tree(catalog, aid, "a.b.Main", "run", depth=9, max_nodes=2).count() == 2
    assert ("a/b", 2, 4) in rows(Q.package_tree(catalog), "path", "depth", "entries")


def test_coverage_and_integrity(catalog):
    assert sorted(r["coverage"] for r in Q.coverage(catalog).collect()) == ["complete", "unknown"]
    assert rows(Q.integrity(catalog), "checksum_ok", "tail_bytes") == [(True, 0), (True, 0)]
    assert A.anomalies(catalog.table("dex")).isEmpty()
    assert rows(Q.packers(catalog), "signals") == [(0,), (0,)]


def test_source_lines(spark):
    """The first row at the offset, else the last one before it, else the method's first line; lines that aren't positive don't count."""
    from dexlake.sources.artifacts import PLACES, SCHEMA

    def wide(kind, **columns):
        return {"kind": kind, "aid": "a", "dx": 0} | {PLACES[kind][k]: v for k, v in columns.items()}

    rows_ = [wide("method", method_idx=m, class_descriptor="La;", name=f"m{m}", signature="()V") for m in range(3)]
    rows_ += [wide("class_method", class_def_idx=0, list=0, ord=m, method_idx=m, access_flags=1, code_off=10 + m) for m in range(3)]
    for m, found in enumerate([[(0, 4, 20), (1, 4, 21), (2, 9, 22), (3, 9, -5)], [(0, 2, 0)]]):
        rows_ += [wide("debug_line", code_off=10 + m, ord=o, pc=pc, line=line, line_start=7) for o, pc, line in found]
    catalog = Catalog(spark.createDataFrame([{c.split()[0]: r.get(c.split()[0]) for c in SCHEMA.split(", ")} for r in rows_], SCHEMA))
    hits = spark.createDataFrame([("a", 0, m, o) for m, o in [(0, 0), (0, 3), (0, 4), (0, 5), (0, 8), (0, 9), (0, 30), (1, 2), (2, 1)]], "aid string, dx int, method_idx long, offset long")
    got = rows(Q.first_source_line(catalog, hits).fillna(-1), "method_idx", "offset", "line")
    assert got == [(0, 0, 7), (0, 3, 7), (0, 4, 20), (0, 5, 21), (0, 8, 21), (0, 9, 22), (0, 30, 22), (1, 2, 7), (2, 1, -1)]


def test_copies_and_long_files(spark, tmp_path):
    for name in ("one.apk", "two.apk"):
        (tmp_path / name).write_bytes(apk())
    (tmp_path / "long.apk").write_bytes(b"x" * 100_000)
    found = read_artifacts(spark, str(tmp_path), "*.apk", longest=50_000)
    catalog = Catalog(wide_records(found).cache())
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["long.apk", "one.apk"]
    assert [r["sites"] for r in Q.call_edges(catalog).where("caller like '%Main%'").collect()] == [2]
    assert sorted(r["coverage"] for r in Q.coverage(catalog).collect()) == ["complete", "unknown"]
    assert "too long" in catalog.table("issue").first()["message"]


@pytest.mark.parametrize(
    ("classes", "files", "text", "signals"),
    [
        (["Lv1f/l1f;"], [], None, 1), (["Lv1f/l1f$a;"], ["assets/l2b_a64.so", "assets/l2b_x86.so"], None, 2), (["Lv1f/l1f;"], ["assets/l2b_a64.so"], None, 1), ([], ["assets/l2b_a64.so", "assets/l2b_x86.so"], None, 1),
        (["Lv1f/l2f;"], ["assets/l2b_a64.so", "assets/l2b_arm.so"], "a Virbox b", 1), (["Lv1f/l1f;"], [], "Virbox", 2),
    ],
)
def test_packers(spark, classes, files, text, signals):
    body = [("string", text)] if text else None
    raw = zip.write([("classes.dex", synth.build([synth.Class("La;", methods=[synth.Method("x", body=body or [("string", "-")])]), *map(synth.Class, classes)])), *((f, b"x") for f in files)])
    catalog = Catalog(wide_records(spark.createDataFrame([("a", "a.apk", bytearray(raw))], "aid string, path string, content binary")))
    (row,) = Q.packers(catalog).collect()
    assert (row["signals"], row["packer"]) == (signals, "virbox" if signals >= 2 else None)


def test_reports_of_odd_artifacts(spark):
    dex = synth.build([synth.Class("La/b/Main;")], tail=b"x" * 70_000, checksum=7)
    bundle = bytearray(hermes.write(["a"]))
    bundle[8:12], bundle[32:36] = (20_000).to_bytes(4, "little"), (9).to_bytes(4, "little")
    manifest = ("manifest", {":package": "z", "requiredSplitTypes": "base__abi"}, [("application", {}, [("activity", {"name": ".No"}, [])])])
    odd = zip.write([("AndroidManifest.xml", axml.write(manifest)), ("classes.dex", dex), ("assets/x.bundle", bytes(bundle))])
    files = spark.createDataFrame([("odd", "odd.apk", bytearray(odd)), ("good", "good.apk", bytearray(apk())), ("raw", "raw.dex", bytearray(synth.build([synth.Class("La;")])))], "aid string, path string, content binary")
    catalog, found = Catalog(wide_records(files).cache()), A.manifests(files).cache()
    got = {r["aid"]: r for r in A.inspect(catalog, found).collect()}
    assert {"classes.dex: tail", "classes.dex: checksum", "assets/x.bundle: bundle version", "assets/x.bundle: bundle length", "splits", "components"} <= set(got["odd"]["anomalies"])
    assert got["good"]["anomalies"] == [] and got["good"]["complete"] and got["raw"]["complete"] and got["raw"]["input_kind"] == "dex"
    assert got["good"]["entry_kinds"]["dex"] == 2 and got["good"]["package"] == "a.b"


def test_filters(catalog):
    assert rows(Q.tree_filter(catalog, "/SUB"), "descriptor") == [("La/b/Sub;",), ("La/b/SubSub;",)]
    hits = Q.find_refs(catalog, "string", "https://")
    assert rows(Q.hit_filter(hits, "HTTPS://Y"), "caller") == [("La/b/Util;->go",)] and rows(Q.hit_filter(hits, "main"), "caller") == [("La/b/Main;->run",)]


def test_inner_classes_are_below_outer_ones(spark):
    raw = synth.build([synth.Class("La/B$C$D;"), synth.Class("La/B;"), synth.Class("LE;")])
    catalog = Catalog(wide_records(spark.createDataFrame([("a", "a.dex", bytearray(raw))], "aid string, path string, content binary")))
    assert rows(Q.package_tree(catalog), "path", "depth", "entries") == [("E", 1, 1), ("a", 1, 2), ("a/B", 2, 2), ("a/B/C", 3, 1), ("a/B/C/D", 4, 1)]


def test_jar_digests_budgets_and_copies(spark):
    import base64
    import hashlib

    def digest(b):
        return base64.b64encode(hashlib.sha256(b).digest()).decode()

    sections = [f"Name: {n}\r\nSHA-256-Digest: {digest(c)}\r\n\r\n" for n, c in (("big", b"b" * 100), ("small", b"s"), ("gone", b""))]
    manifest = "Manifest-Version: 1.0\r\n\r\n" + "".join(sections)
    signature = "Signature-Version: 1.0\r\n\r\n" + f"Name: big\r\nSHA-256-Digest: {digest(sections[0].encode())}\r\n\r\nName: small\r\nSHA-256-Digest: {digest(b'?')}\r\n\r\n"
    raw = zip.write([("META-INF/MANIFEST.MF", manifest.encode()), ("META-INF/A.SF", signature.encode()), ("big", b"b" * 100), ("small", b"s"), ("small", b"again"), ("extra", b"e")])
    frame = spark.createDataFrame([("a", bytearray(raw))], "aid string, content binary")

    def shown(budget):
        return sorted((r["name"], r["status"], r["digest_ok"], r["sf_ok"], r["copies"]) for r in A.jar_coverage(frame, budget).collect())

    assert shown(1 << 20) == [("big", "covered", True, True, 1), ("extra", "uncovered", None, None, 1), ("gone", "missing", None, None, 0), ("small", "covered", True, False, 2)]
    assert [r[2] for r in shown(50)] == [None, None, None, True]


def test_native_binding(spark, catalog):
    methods = Q.native_methods(catalog)
    assert rows(methods, "short_name", "long_name") == [("Java_a_b_Main_nat", "Java_a_b_Main_nat__I")]
    aid = methods.first()["aid"]
    exports = spark.createDataFrame([(aid, "lib/x.so", "Java_a_b_Main_nat__I"), (aid, "lib/a.so", "Java_a_b_Main_nat")], "aid string, lib string, symbol string")
    bound = Q.bind_exports(methods, exports)
    assert bound.first()["libs"] == ["lib/a.so", "lib/x.so"]
    tables = spark.createDataFrame([(aid, "lib/z.so", 1, "nat", "(I)V"), (aid, "lib/b.so", 2, "nat", "(I)V"), (aid, "lib/b.so", 2, "nat", "(I)V"), (aid, "lib/c.so", 3, "nat", "()V")], "aid string, lib string, lib_ord int, name string, signature string")
    listed = Q.bind_tables(bound, tables)
    assert listed.first()["table_libs"] == ["lib/z.so", "lib/b.so"]
    assert rows(Q.binding_counts(listed), "methods", "by_name", "by_table", "unbound") == [(1, 1, 1, 0)]


def test_manifest_operators(files, catalog):
    found = A.manifests(files)
    assert sorted(r["error"] is None for r in found.collect()) == [False, True]
    parts = A.components(found)
    assert rows(parts, "class_name") == [("a.b.Main",), ("a.b.P",), ("c.S",)]
    assert A.missing_components(parts, catalog.table("class_def")).first()["examples"] == ["a.b.P", "c.S"]
    assert [r["verdict"] for r in A.match_uri(A.intent_filters(parts), "https://e.com/x").collect()] == ["matches"]
    assert A.xml_nodes(files).where("name = 'activity'").count() == 1


def test_bundles_containers_extraction(spark, files, folder):
    strings = A.hermes_strings(files)
    assert rows(A.find_hermes(strings, "w"), "text") == [("wörld",)]
    xapk = read_artifacts(spark, str(folder), "*.xapk")
    assert rows(A.members(xapk), "name", "role", "package", "dex_count") == [("base.apk", "base", "a.b", 2)]
    assert A.members(xapk, budget=10).first()["error"] == "over the budget"
    got = A.extract_entry(files, "classes2.dex", verify=True).where("error is null").first()
    assert got["crc_ok"] and got["file_name"] == "classes2.dex"
    assert rows(A.jar_coverage(files), "error")[0][0]


def test_limits_are_each_artifacts(spark):
    res = spark.sql("select aid, cast(i as int) as ord, i as res_id, 'key' as key, 'v' as text, cast(array() as array<struct<name:long,text:string>>) as items, cast(null as string) as error from values ('a'), ('b') as t(aid) lateral view explode(sequence(0L, 119L)) as i")
    got = A.find_resources(res, needle="key").groupBy("aid", "total", "truncated").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"))
    assert rows(got, "aid", "total", "truncated", "n", "last") == [("a", 120, True, 100, 99), ("b", 120, True, 100, 99)]
    many = spark.sql("select aid, '' as bundle, id as string_idx, 'text' as text, cast(null as string) as error from range(100005) cross join values ('a'), ('b') as t(aid)")
    assert rows(A.find_hermes(many, "t").groupBy("aid", "truncated").count(), "aid", "truncated", "count") == [("a", True, 100_000), ("b", True, 100_000)]
    assert A.find_hermes(many, "t", limit=200_000).where("not truncated").count() == 200_010


def test_mapping(spark):
    text = ["a.B -> x:", "    int f -> a", "    1:2:void go(int) -> b", "junk", "    int lost -> c", "a.C -> y:", "    void go() -> b"]
    lines = spark.createDataFrame([("m", i, t) for i, t in enumerate(text)], "file string, line_no long, value string")
    classes, members = mapping.parse(lines)
    assert rows(classes, "original", "obfuscated") == [("a.B", "x"), ("a.C", "y")]
    assert rows(members, "class_original", "original", "obfuscated") == [("a.B", "f", "a"), ("a.B", "go", "b"), ("a.C", "go", "b")]
    assert rows(mapping.lookup(classes, members, " A.b "), "section", "ordinal") == [(0, 0), (1, 1), (1, 2)]
    assert mapping.lookup(classes, members, " ").isEmpty()
    labels = spark.createDataFrame([("Lx;", "b"), ("Lq;", "b")], "cls string, name string")
    named = mapping.with_original_names(labels, classes, members, class_col="cls", name_col="name")
    assert rows(named.fillna("-"), "cls", "original_class", "original_member") == [("Lq;", "-", "-"), ("Lx;", "a.B", "go")]


def test_streaming_ingest(spark, folder, tmp_path):
    stream = ingest.artifact_stream(spark, str(folder), files_per_trigger=1)
    ingest.ingest_stream(stream, str(tmp_path / "c"), str(tmp_path / "s")).awaitTermination(120)
    got = Catalog(spark.read.parquet(str(tmp_path / "c")))
    assert got.table("class_def").count() == 4 and got.wide.agg(F.count_distinct("batch")).first()[0] == 2


def test_results_say_how_they_ended(spark, catalog, tmp_path):
    from dexlake.operators import reports

    one = synth.build([synth.Class("La;", methods=[synth.Method("x", body=[("string", "s")])])])
    whole = Catalog(wide_records(spark.createDataFrame([("a", "a.dex", bytearray(one))], "aid string, path string, content binary")).cache())
    hits = Q.find_refs(whole, "string", "s")
    assert reports.result(whole, hits).exit_code() == 0 and reports.result(whole, Q.find_refs(whole, "string", "zz")).exit_code() == 1
    assert reports.result(catalog, hits).exit_code() == 2
    reports.write(reports.text_lines(whole, hits), str(tmp_path / "text"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["a.dex | La;->x | matched=(s)"]
    assert '"matched_text":"s"' in reports.json_lines(hits).first()[0] and '"note":null' in reports.json_lines(hits.withColumn("note", F.lit(None).cast("string"))).first()[0]
    reports.check_raw_dex(whole)
    broken = Catalog(wide_records(spark.createDataFrame([("b", "b.dex", bytearray(b"dex\n036\0" + bytes(200)))], "aid string, path string, content binary")))
    with pytest.raises(ValueError, match="b.dex"):
        reports.check_raw_dex(broken)


def test_long_dex_entries_are_skipped(monkeypatch):
    from dexlake.sources import artifacts

    monkeypatch.setattr(artifacts, "LONGEST_DEX", 300)
    raw = zip.write([("classes.dex", synth.build([synth.Class(f"La{k};") for k in range(40)])), ("classes2.dex", synth.build([synth.Class("LB;")]))])
    found = [(t, dx, c.get("status")) for t, dx, c in artifacts.records("a.apk", raw) if t == "dex"]
    assert found == [("dex", 0, "skipped"), ("dex", 1, "view")] and [c["failed"] for t, _, c in artifacts.records("a.apk", raw) if t == "issue"] == [1]


def test_tagged_jobs(spark):
    with ingest.tagged(spark, "search"):
        assert spark.range(3).count() == 3 and set(spark.sparkContext.getJobTags()) == {"search"}
    assert not set(spark.sparkContext.getJobTags())
    ingest.cancel(spark, "search")


def test_signs_of_failed_decompilation(spark):
    from dexlake.functions import javatext as J

    text = """class A {
    int go(int p0) {
        int v1_0 = 3; // v9_9 isn't read here
        v2_0 += v1_0;
        String s = "v8_8 { ";
        return v3_1 + v1_0;
    }
    void other() {
        foo(v1_0);
        v3_1 = 2;
    }
}"""
    assert J.unbound_locals(text) == ["v1_0", "v3_1"]
    body = "log(\"} catch (X e) {\"); closeEverything(first, second); rethrow(e);"
    three = "".join(f"try {{ a(); }} catch (E e) {{ {body} }}\n" for _ in range(3)) + "catch (F f) { short(); }"
    assert J.most_repeated(J.catch_bodies(three)) == 3 and J.most_repeated(J.catch_bodies("try { } catch (E e) { " + body + " }")) == 0
    loop = "while (x) {\n  y = read();\n  if (a) {\n  b();\n  }\n  y = read();\n}"
    assert J.rotated_loops(loop) == 1 and J.rotated_loops(loop.replace("y = read();", "return;")) == 0 and J.rotated_loops("while (x) {\n a();\n b();\n}") == 0
    frame = spark.createDataFrame([(1, text), (2, three), (3, None)], "id int, text string")
    assert rows(J.diagnosed(frame), "id", "unbound_locals", "repeated_catches", "rotated_loops") == [(1, ["v1_0", "v3_1"], 0, 0), (2, [], 3, 0), (3, [], 0, 0)]
