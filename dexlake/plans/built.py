"""Queries over whole artifacts: packages are built from the rows of the driver's tables, read again, and asked; SQL says what must come out.

Each chunk of parts becomes one package ``t.c<chunk>``.  Part k has an activity ``t.P<k>`` (exported where its size is over 25, with a link to the host of its
size), a class ``Lt/P<k>;`` (not so where the size is 13: that component is missing) with a native method ``n<k>`` that a library exports where the size is
even and a registration table lists where it is a multiple of three, a resource ``k<k>`` and a string of a bundle with its name, and an asset with its name's
bytes that the JAR manifest covers where the size is not 7.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexlake.operators import artifacts as A
from dexlake.operators import deobfuscate, disasm, mapping, rebuild
from dexlake.operators import dexquery as Q
from dexlake.plans.driver import query
from dexlake.plans.lineage import cut, folder
from dexlake.sources.artifacts import Catalog

CHUNK = 500
_MADE: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, d: str, name: str, make):
    """What ``make`` gives, made once for a session and a data folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _package(chunk: int, keys: list[int], names: list[str], sizes: list[int]) -> bytes:
    from dexlake.formats import arsc, axml, elf, hermes, synth, zip

    activities, classes, symbols, tables, assets, listed = [], [], [], [], [], "Manifest-Version: 1.0\r\n\r\n"
    for k, name, size in zip_strict(keys, names, sizes):
        link = ("intent-filter", {}, [("action", {"name": "android.intent.action.VIEW"}, []), ("data", {"scheme": "https", "host": f"h{size}.example", "pathPrefix": "/p"}, [])])
        activities.append(("activity", {"name": f"t.P{k}"} | ({"exported": True} if size > 25 else {}), [link] if size > 25 else []))
        if size != 13:
            body = [("string", name), ("call", (f"Lt/P{k // 4};", "m", "()V"))]
            classes.append(synth.Class(f"Lt/P{k};", methods=[synth.Method("m", flags=9, body=body, virtual=False), synth.Method(f"n{k}", flags=0x101)]))
        if size % 2 == 0:
            symbols.append(f"Java_t_P{k}_n{k}")
        if size % 3 == 0:
            tables.append((f"n{k}", "()V"))
        assets.append((f"assets/{k}.txt", name.encode()))
        if size != 7:
            listed += f"Name: assets/{k}.txt\r\nSHA-256-Digest: {base64.b64encode(hashlib.sha256(name.encode()).digest()).decode()}\r\n\r\n"
    root = ("manifest", {":package": f"t.c{chunk}", "versionCode": chunk + 1}, [("uses-sdk", {"minSdkVersion": 21, "targetSdkVersion": 33}, []), ("application", {}, activities)])
    return zip.write([
        ("AndroidManifest.xml", axml.write(root)), ("classes.dex", synth.build(classes)), ("resources.arsc", arsc.write(f"t.c{chunk}", "string", [(f"k{k}", n) for k, n in zip_strict(keys, names)])),
        ("assets/index.android.bundle", hermes.write(names)), ("lib/arm64-v8a/libn.so", elf.write(symbols, tables)), ("META-INF/MANIFEST.MF", listed.encode()), *assets,
    ])


def zip_strict(*columns):
    return zip(*columns, strict=True)


def packages(spark: SparkSession, d: str) -> DataFrame:
    """(aid, path, content): a package for each chunk of parts."""

    def made() -> DataFrame:
        parts = spark.read.parquet(f"{d}/part.parquet").select(F.expr(f"p_partkey div {CHUNK}").alias("chunk"), "p_partkey", F.coalesce("p_name", F.lit("")).alias("p_name"), "p_size")

        def built(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("p_partkey")
            chunk = key[0].as_py()
            content = _package(chunk, *(rows[c].to_pylist() for c in ("p_partkey", "p_name", "p_size")))
            return pa.table({"aid": [f"c{chunk}"], "path": [f"c{chunk}.apk"], "content": [content]})

        return cut(parts.groupBy("chunk").applyInArrow(built, "aid string, path string, content binary"))

    return once(spark, d, "packages", made)


def catalog(spark: SparkSession, d: str) -> Catalog:
    return once(spark, d, "catalog", lambda: Catalog.write(packages(spark, d), folder(spark), mode="overwrite"))


def manifests(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "manifests", lambda: cut(A.manifests(packages(spark, d))))


def chunk_of(column: str = "aid") -> F.Column:
    return F.expr(f"cast(substring({column}, 2) as long)")


def key_of(column: str, form: str = "^Lt/P(\\d+);") -> F.Column:
    return F.regexp_extract(column, form, 1).cast("long")


_CHUNK = f"p_partkey // {CHUNK}"


# manifests and links -------------------------------------------------------------------------------------------------------


@query(f"SELECT {_CHUNK} AS chunk, 't.c' || ({_CHUNK}) AS package, ({_CHUNK} + 1)::BIGINT AS version_code, 33::BIGINT AS target_sdk, count(*)::INTEGER AS components FROM part GROUP BY ALL")
def apk_manifests(spark, d):
    return manifests(spark, d).select(chunk_of().alias("chunk"), "package", "version_code", "target_sdk", F.size("components").alias("components"))


@query("SELECT p_partkey AS part, 'Lt/P' || p_partkey || ';' AS descriptor, p_size > 25 AS exported, CASE WHEN p_size > 25 THEN 'explicit' ELSE 'legacy_inferred' END AS state FROM part")
def apk_components(spark, d):
    c = A.components(manifests(spark, d))
    return c.select(key_of("descriptor").alias("part"), "descriptor", F.col("effective_exported").alias("exported"), F.col("exported_state").alias("state"))


@query(f"SELECT chunk, count(*)::BIGINT AS missing, string_agg(name, ',' ORDER BY p_partkey) FILTER (WHERE n <= 10) AS examples FROM (SELECT {_CHUNK} AS chunk, p_partkey, 't.P' || p_partkey AS name, row_number() OVER (PARTITION BY {_CHUNK} ORDER BY p_partkey) AS n FROM part WHERE p_size = 13) GROUP BY chunk")
def missing_components(spark, d):
    gone = A.missing_components(A.components(manifests(spark, d)), catalog(spark, d).table("class_def"))
    return gone.select(chunk_of().alias("chunk"), F.col("missing").cast("long").alias("missing"), F.array_join("examples", ",").alias("examples"))


@query("SELECT p_partkey AS part, CASE WHEN p_size = 40 THEN 'matches' ELSE 'cannot_match' END AS verdict FROM part WHERE p_size > 25")
def uri_verdict(spark, d):
    filters = A.intent_filters(A.components(manifests(spark, d)))
    return A.match_uri(filters, "https://H40.example/p/x?y").select(key_of("name", "^t\\.P(\\d+)$").alias("part"), "verdict")


# resources, bundles, entries ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS part, p_name AS text, 'value' AS matched FROM part WHERE contains(p_name, 'ring')")
def resource_search(spark, d):
    found = A.find_resources(A.resources(packages(spark, d)), needle="ring", limit=CHUNK)
    return found.select(key_of("key", "^k(\\d+)$").alias("part"), "text", "matched")


@query(f"SELECT {_CHUNK} AS chunk, 'string' AS type, count(*)::BIGINT AS entries FROM part GROUP BY ALL")
def resource_summary(spark, d):
    return A.resource_summary(A.resources(packages(spark, d))).select(chunk_of().alias("chunk"), "type", "entries")


@query(f"SELECT {_CHUNK} AS chunk, (row_number() OVER (PARTITION BY {_CHUNK} ORDER BY p_partkey) - 1)::BIGINT AS string_idx, p_name AS text FROM part")
def hermes_strings(spark, d):
    return A.hermes_strings(packages(spark, d)).select(chunk_of().alias("chunk"), "string_idx", "text")


@query(f"SELECT {_CHUNK} AS chunk, p_partkey AS part, strlen(p_name)::BIGINT AS size, p_name AS content FROM part")
def zip_entries(spark, d):
    """The assets: sizes from the central directory, contents from the samples."""
    c = catalog(spark, d)
    entries = c.table("zip_entry").where("name like 'assets/%.txt'").select("aid", "entry_idx", "name", "uncompressed_size")
    heads = c.table("entry_sample").select("aid", "entry_idx", "head")
    return entries.join(heads, ["aid", "entry_idx"]).select(chunk_of().alias("chunk"), key_of("name", "^assets/(\\d+)\\.txt$").alias("part"), F.col("uncompressed_size").alias("size"), F.decode("head", "utf-8").alias("content"))


@query(f"SELECT {_CHUNK} AS chunk, 'classes.dex' AS file_name, true AS crc_ok FROM part GROUP BY ALL")
def extract_entry(spark, d):
    return A.extract_entry(packages(spark, d), "classes.dex", verify=True).select(chunk_of().alias("chunk"), "file_name", "crc_ok")


# native code ----------------------------------------------------------------------------------------------------------------


def _bound(spark: SparkSession, d: str) -> DataFrame:
    libraries = A.native_libraries(packages(spark, d))
    methods = Q.bind_exports(Q.native_methods(catalog(spark, d)), A.exports(libraries))
    return Q.bind_tables(methods, A.jni_entries(libraries))


@query("SELECT p_partkey AS part, CASE WHEN p_size % 2 = 0 THEN 'lib/arm64-v8a/libn.so' ELSE '' END AS by_name, CASE WHEN p_size % 3 = 0 THEN 'lib/arm64-v8a/libn.so' ELSE '' END AS by_table FROM part WHERE p_size <> 13")
def native_binding(spark, d):
    return _bound(spark, d).select(key_of("class_descriptor").alias("part"), F.array_join("libs", ",").alias("by_name"), F.array_join("table_libs", ",").alias("by_table"))


@query(f"SELECT {_CHUNK} AS chunk, count(*)::BIGINT AS methods, count(*) FILTER (WHERE p_size % 2 = 0)::BIGINT AS by_name, count(*) FILTER (WHERE p_size % 3 = 0)::BIGINT AS by_table, count(*) FILTER (WHERE p_size % 2 <> 0 AND p_size % 3 <> 0)::BIGINT AS unbound FROM part WHERE p_size <> 13 GROUP BY ALL")
def binding_counts(spark, d):
    return Q.binding_counts(_bound(spark, d)).select(chunk_of().alias("chunk"), "methods", "by_name", "by_table", "unbound")


@query("SELECT p_partkey AS part, regexp_full_match(p_name, '[A-Za-z0-9_$-]+') AS name_ok, false AS signature_ok FROM part")
def jni_validators(spark, d):
    from dexlake.functions import scalar as S

    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part"), S.jni_name_ok(F.col("p_name")).alias("name_ok"), S.jni_signature_ok(F.col("p_name")).alias("signature_ok"))


# signing, containers, reports -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS part, CASE WHEN p_size = 7 THEN 'uncovered' ELSE 'covered' END AS status, CASE WHEN p_size <> 7 THEN true END AS digest_ok FROM part")
def jar_coverage(spark, d):
    found = A.jar_coverage(packages(spark, d)).where("name like 'assets/%.txt'")
    return found.select(key_of("name", "^assets/(\\d+)\\.txt$").alias("part"), "status", "digest_ok")


@query(f"SELECT {_CHUNK} AS chunk, 'complete' AS coverage, 'apk' AS input_kind, count(*)::BIGINT + 6 AS entry_count, 1::BIGINT AS dex_count, true AS complete, '' AS anomalies, NULL::VARCHAR AS packer FROM part GROUP BY ALL")
def inspect_report(spark, d):
    report = A.inspect(catalog(spark, d), manifests(spark, d))
    return report.select(chunk_of().alias("chunk"), "coverage", "input_kind", "entry_count", "dex_count", "complete", F.array_join("anomalies", "; ").alias("anomalies"), "packer")


@query(f"SELECT {_CHUNK} // 4 AS container, 'c' || ({_CHUNK}) || '.apk' AS name, 'base' AS role, 't.c' || ({_CHUNK}) AS package, 1 AS dex_count, 'arm64-v8a' AS abis FROM part GROUP BY ALL")
def container_members(spark, d):
    """Four packages in each container."""

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        from dexlake.formats import zip as zipped

        files = sorted(zip_strict(rows["path"].to_pylist(), rows["content"].to_pylist()))
        return pa.table({"aid": [str(key[0].as_py())], "path": ["all.xapk"], "content": [zipped.write([(p, c, 0) for p, c in files])]})

    held = packages(spark, d).withColumn("container", F.expr("cast(substring(aid, 2) as long) div 4"))
    containers = held.groupBy("container").applyInArrow(built, "aid string, path string, content binary")
    return A.members(containers).select(F.col("aid").cast("long").alias("container"), "name", "role", "package", "dex_count", F.array_join("abis", ",").alias("abis"))


# code -------------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS part, 3::BIGINT AS instructions FROM part WHERE p_size <> 13")
def code_blocks(spark, d):
    """Every body is one block: a string is loaded, a method is called, the body ends."""
    c = catalog(spark, d)
    blocks, _ = disasm.blocks(disasm.instruction_rows(c.table("code_item")))
    return blocks.join(Q.owners(c), ["aid", "dx", "code_off"]).select(key_of("class_descriptor").alias("part"), F.col("instructions").cast("long").alias("instructions"))


@query("SELECT p_partkey AS part, 'm' AS method, p_name AS loaded FROM part WHERE p_size <> 13")
def code_listing(spark, d):
    text = F.col("text")
    return disasm.listing(catalog(spark, d)).where(text.contains("const-string")).select(key_of("text", "invoke-static [^\\n]*Lt/P(\\d+);").alias("called"), key_of("caller").alias("part"), F.lit("m").alias("method"), F.regexp_extract("text", 'const-string v\\d+, "([^"]*)"', 1).alias("loaded")).select("part", "method", "loaded")


@query("SELECT p_partkey AS part, p_name AS text FROM part WHERE p_partkey = 42 AND p_size <> 13")
def rebuilt_class(spark, d):
    from dexlake.sources.artifacts import wide_records

    small = rebuild.rebuilt_classes(packages(spark, d), "Lt/P42;").where("error is null").select("aid", F.lit("classes.dex").alias("path"), "content")
    c = Catalog(cut(wide_records(small)))
    return Q.class_strings(c, "t.P42").select(F.lit(42).cast("long").alias("part"), "text")


@query("SELECT p_partkey AS part, p_name AS text FROM part")
def hidden_strings(spark, d):
    """Names are hidden in chunks of characters behind ids, and revealed again."""

    def hidden(key: tuple, rows: pa.Table) -> pa.Table:
        ids, chunks = deobfuscate.hide(rows["p_name"].to_pylist(), seed=key[0].as_py() + 1)
        units = [[ord(u) for u in c] for c in chunks]
        return pa.table({"part": rows["p_partkey"], "number": pa.array([i - (1 << 64) if i >> 63 else i for i in ids], pa.int64()), "chunks": pa.array([units] * len(ids), pa.list_(pa.list_(pa.int32())))})

    parts = spark.read.parquet(f"{d}/part.parquet").select(F.expr("p_partkey div 50").alias("chunk"), "p_partkey", F.coalesce("p_name", F.lit("")).alias("p_name"))
    made = parts.groupBy("chunk").applyInArrow(hidden, "part long, number long, chunks array<array<int>>")
    return made.select("part", deobfuscate.revealed(F.col("number"), F.col("chunks")).alias("text"))


def _hiding(names: list[str], keys: list[int], seed: int) -> bytes:
    """A DEX whose class Lq/D; decodes, and in which method m<key> of Lq/Use; asks for the name of part ``key``."""
    from dexlake.formats import synth

    ids, chunks = deobfuscate.hide(names, seed)
    box, get = ("Lq/D;", "c", deobfuscate.STRINGS), ("Lq/D;", "get", deobfuscate.DECODER)
    # const/16 v0, size; new-array v0, v0; then for each chunk const/16 v1, place; const-string v2; aput-object v2, v0, v1; sput-object v0; return-void
    insns, refs = b"\x13\0" + len(chunks).to_bytes(2, "little") + bytes.fromhex("23000000"), [(3, "type", deobfuscate.STRINGS, 2)]
    for k, chunk in enumerate(chunks):
        insns += b"\x13\x01" + k.to_bytes(2, "little")
        refs.append((len(insns) // 2 + 1, "string", chunk, 2))
        insns += bytes.fromhex("1a020000" "4d020001")
    refs.append((len(insns) // 2 + 1, "field", box, 2))
    start = synth.Code(3, 0, 0, insns + bytes.fromhex("69000000" "0e00"), refs)
    # sget-object v0; const-wide v1, multiplier; const/4 v0, 0; return-object v0
    body = synth.Code(5, 2, 0, bytes.fromhex("62000000" "1801") + deobfuscate.SEED_MULTIPLIERS[0].to_bytes(8, "little") + bytes.fromhex("1200" "1100"), [(1, "field", box, 2)])
    # const-wide v0, id; invoke-static {v0, v1}; move-result-object v0; return-void
    asks = [synth.Method(f"m{k}", flags=9, virtual=False, code=synth.Code(2, 0, 2, b"\x18\0" + i.to_bytes(8, "little") + bytes.fromhex("712000001000" "0c00" "0e00"), [(6, "method", get, 2)])) for k, i in zip_strict(keys, ids)]
    decoder = [synth.Method("<clinit>", flags=0x10008, virtual=False, code=start), synth.Method("get", deobfuscate.DECODER, 9, virtual=False, code=body)]
    return synth.build([synth.Class("Lq/D;", fields=[("c", deobfuscate.STRINGS, 9, True)], methods=decoder), synth.Class("Lq/Use;", methods=asks)])


@query("SELECT p_partkey AS part, p_name AS text FROM part")
def hidden_calls(spark, d):
    """Decoders are found in built DEX files, and the calls of them are resolved."""

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        return pa.table({"aid": [f"h{chunk}"], "path": [f"h{chunk}.dex"], "content": [_hiding(rows["p_name"].to_pylist(), rows["p_partkey"].to_pylist(), chunk + 1)]})

    def made() -> Catalog:
        parts = spark.read.parquet(f"{d}/part.parquet").select(F.expr(f"p_partkey div {CHUNK}").alias("chunk"), "p_partkey", F.coalesce("p_name", F.lit("")).alias("p_name"))
        return Catalog.write(cut(parts.groupBy("chunk").applyInArrow(built, "aid string, path string, content binary")), folder(spark), mode="overwrite")

    c = once(spark, d, "hidden", made)
    calls = deobfuscate.decoded_calls(c, deobfuscate.decoders(c)).join(Q.owners(c), ["aid", "dx", "code_off"])
    return calls.select(key_of("name", "^m(\\d+)$").alias("part"), "text")


# names ------------------------------------------------------------------------------------------------------------------------


@query("SELECT 0 AS section, 2 * p_partkey AS ordinal, 't.' || replace(p_name, ' ', '_') AS original, 'x.P' || p_partkey AS obfuscated FROM part WHERE contains(lower('t.' || replace(p_name, ' ', '_')), 'gear') UNION ALL SELECT 1, 2 * p_partkey + 1, 't.' || replace(p_name, ' ', '_') || '.size', 'x.P' || p_partkey || '.a' FROM part WHERE contains(lower('t.' || replace(p_name, ' ', '_')), 'gear')")
def mapping_lookup(spark, d):
    """A mapping with a class and a member for each part."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    lines = part.select(F.lit("m").alias("file"), F.expr("stack(2, 2 * p_partkey, concat('t.', n, ' -> x.P', p_partkey, ':'), 2 * p_partkey + 1, '    int size -> a') as (line_no, value)"))
    return mapping.lookup(*mapping.parse(lines), " GEAR ").select("section", "ordinal", "original", "obfuscated")


@query("SELECT p_partkey AS part FROM part WHERE p_size <> 13 AND contains('lt/p' || p_partkey || ';', '/p1')")
def tree_filter(spark, d):
    return Q.tree_filter(catalog(spark, d), "/P1").select(key_of("descriptor").alias("part"))


@query("SELECT p_partkey AS part FROM part WHERE p_size <> 13 AND contains(p_name, 'ring') AND (contains('lt/p' || p_partkey || ';->m', 'hot') OR contains(lower(p_name), 'hot'))")
def hit_filter(spark, d):
    return Q.hit_filter(Q.find_refs(catalog(spark, d), "string", "ring"), "HOT").select(key_of("caller").alias("part"))


@query("SELECT p_partkey AS part, p_name AS text, 1::BIGINT AS sites FROM part WHERE p_partkey = 77 AND p_size <> 13")
def class_strings(spark, d):
    return Q.class_strings(catalog(spark, d), "t.P77").select(F.lit(77).cast("long").alias("part"), "text", "sites")
