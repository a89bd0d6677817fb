"""Commands over whole artifacts: manifest, native code, signing, resources, bundles, containers, extraction.

Each reads (aid, path, content), lets a parser turn chosen entries into rows (an artifact at a time, in Arrow batches) and leaves everything after
that to DataFrame operations.  What can't be read becomes a row with ``error`` set; nothing else of the artifact is lost.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexlake.formats import arsc, axml, elf, hermes, signing, zip
from dexlake.formats.binary import FormatError
from dexlake.functions import scalar as S
from dexlake.functions import uri as U
from dexlake.operators import relational as R
from dexlake.sources.artifacts import BATCH_BYTES


def per_artifact(artifacts: DataFrame, rows_of: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """aid and the rows that ``rows_of`` makes of the content; an artifact that can't be read has one row with ``error``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"aid string, {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                aid, content = batch.column(0)[i].as_py(), batch.column(1)[i]
                made = []
                try:
                    for row in rows_of(content.as_py() or b""):
                        made.append(dict.fromkeys(names) | row | {"aid": aid})
                except (FormatError, IndexError, struct.error, UnicodeError, ValueError) as e:
                    made.append(dict.fromkeys(names) | {"aid": aid, "error": str(e) or type(e).__name__})
                for at in range(0, len(made), 4096):
                    yield pa.RecordBatch.from_pylist(made[at : at + 4096], schema=arrow)

    artifacts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return artifacts.select("aid", "content").mapInArrow(run, full)


def _entry(data: bytes, name: str) -> bytes | None:
    found = next((e for e in zip.entries(data) if e.name == name), None)
    return None if found is None else zip.read(data, found)


# manifest --------------------------------------------------------------------------------------------------------------

DATA = "scheme:string,host:string,port:string,path:string,path_prefix:string,path_suffix:string,path_pattern:string,path_advanced_pattern:string,mime_type:string"
FILTER = f"struct<actions:array<string>,categories:array<string>,data:array<struct<{DATA}>>,groups:array<struct<allow:boolean,data:array<struct<parts:array<struct<part:string,kind:string,value:string>>>>>>>"
COMPONENT = f"struct<kind:string,ord:int,name:string,exported:boolean,effective_exported:boolean,exported_state:string,permission:string,process:string,authorities:string,target:string,filters:array<{FILTER}>>"
MANIFEST = f"package string, version_code long, version_name string, min_sdk long, target_sdk long, effective_target long, split string, required_splits boolean, permissions array<struct<kind:string,name:string>>, features array<struct<name:string,required:boolean>>, queries array<struct<kind:string,name:string>>, debuggable boolean, allow_backup boolean, cleartext boolean, application string, components array<{COMPONENT}>"


def manifests(artifacts: DataFrame) -> DataFrame:
    """One row for each manifest (of AndroidManifest.xml, or of content that is binary XML itself)."""

    def rows(data: bytes) -> Iterator[dict]:
        raw = data if data[:4] == b"\x03\0\x08\0" else _entry(data, "AndroidManifest.xml")
        if raw is None:
            raise FormatError("no manifest")
        yield axml.manifest(raw)

    return per_artifact(artifacts, rows, MANIFEST)


def components(manifests_: DataFrame) -> DataFrame:
    """One row for each component, with its class."""
    c = manifests_.where("error is null").select("aid", "package", "effective_target", F.explode("components").alias("c")).select("aid", "package", "c.*")
    return c.withColumn("class_name", S.component_class(F.col("package"), F.col("name"))).withColumn("descriptor", S.normalize_descriptor(F.col("class_name")))


def intent_filters(components_: DataFrame) -> DataFrame:
    return components_.select("aid", "kind", "ord", "name", F.posexplode("filters").alias("filter_ord", "f")).select("aid", "kind", "ord", "name", "filter_ord", "f.*")


def match_uri(filters: DataFrame, uri: str, flag_on: bool = True) -> DataFrame:
    """Verdict of every filter for a URI."""
    import pandas as pd

    def each(rows: pd.Series) -> pd.Series:
        return pd.Series([U.verdict(json.loads(r), uri, flag_on) for r in rows], dtype="object")

    judged = F.pandas_udf(each, "string", F.PandasUDFType.SCALAR)
    return filters.withColumn("verdict", judged(F.to_json(F.struct("data", "groups"))))


def missing_components(components_: DataFrame, class_defs: DataFrame) -> DataFrame:
    """Components whose class no DEX of the artifact defines: count and the first ten."""
    wanted = components_.where("kind <> 'activity-alias'")
    gone = wanted.join(class_defs.select("aid", "descriptor").distinct(), ["aid", "descriptor"], "left_anti")
    rows = R.limit_with_total(gone.select("aid", "ord", "class_name"), 10, ["ord"], ["aid"])  # ten rows of each go on, not all
    first = F.transform(F.array_sort(F.collect_list(F.struct("ord", "class_name"))), lambda x: x["class_name"])
    return rows.groupBy("aid").agg(F.first("total").alias("missing"), first.alias("examples"))


def xml_nodes(artifacts: DataFrame, entry: str = "AndroidManifest.xml") -> DataFrame:
    """Nodes of a binary XML entry as an adjacency list, with attributes."""

    def rows(data: bytes) -> Iterator[dict]:
        raw = data if data[:4] == b"\x03\0\x08\0" else _entry(data, entry)
        yield from axml.nodes(raw) if raw is not None else ()

    return per_artifact(artifacts, rows, "node_id int, parent_id int, ord int, kind string, ns string, name string, text string, attrs array<struct<ns:string,name:string,kind:int,value:long,text:string>>")


# resources, bundles ----------------------------------------------------------------------------------------------------


def resources(artifacts: DataFrame) -> DataFrame:
    def rows(data: bytes) -> Iterator[dict]:
        raw = data if data[:4] == b"\x02\0\x0c\0" else _entry(data, "resources.arsc")
        if raw is None:
            raise FormatError("no resource table")
        for k, row in enumerate(arsc.resources(raw)):
            yield row | {"ord": k}

    return per_artifact(artifacts, rows, "ord int, package string, res_id long, type string, key string, config string, value_kind int, value long, text string, items array<struct<name:long,text:string>>")


def find_resources(res: DataFrame, *, res_id: int | None = None, needle: str = "", limit: int = 100) -> DataFrame:
    """Values by id (all configurations), else by key, else by value; ``matched`` says by which.  The limit and the total are each artifact's."""
    if res_id is not None:
        matched = F.when(F.col("res_id") == res_id, "id")
    else:
        inside = F.coalesce(F.col("text").contains(needle), F.lit(False)) | F.exists("items", lambda x: x["text"].contains(needle))
        matched = F.when(F.col("key").contains(needle), "key").when(inside, "value")
    found = res.where("error is null").withColumn("matched", matched).where("matched is not null").withColumn("preview", F.slice("items", 1, 8))
    return R.limit_with_total(found, limit, ["ord"], ["aid"])


def resource_summary(res: DataFrame) -> DataFrame:
    """Distinct ids of each type, types in order of first mention."""
    return res.where("error is null").groupBy("aid", "package", "type").agg(F.count_distinct("res_id").alias("entries"), F.min("ord").alias("first_ord"))


def hermes_strings(artifacts: DataFrame) -> DataFrame:
    """Strings of every Hermes bundle of an artifact; an unsupported version is a row with a note in ``error``."""

    def rows(data: bytes) -> Iterator[dict]:
        if data.startswith(hermes.MAGIC):
            bundles = [("", data)]
        else:
            bundles = []
            for e in zip.entries(data):
                try:
                    if zip.prefix(data, e, 36)[0].startswith(hermes.MAGIC):
                        bundles.append((e.name, zip.read(data, e)))
                except FormatError:
                    continue
        for name, raw in bundles:
            version = hermes.version_of(raw)
            try:
                for i, kind, text in hermes.strings(raw):
                    yield {"bundle": name, "version": version, "string_idx": i, "kind": kind, "text": text}
            except FormatError as e:
                yield {"bundle": name, "version": version, "error": str(e)}

    return per_artifact(artifacts, rows, "bundle string, version long, string_idx long, kind string, text string")


def find_hermes(found: DataFrame, pattern: str = "", limit: int = 100_000) -> DataFrame:
    """Strings with the pattern; the limit and the total are each artifact's."""
    hits = found.where("error is null")
    hits = hits.where(F.col("text").contains(pattern)) if pattern else hits
    return R.limit_with_total(hits, limit, ["bundle", "string_idx"], ["aid"]).withColumn("shown", S.mask_control(F.col("text")))


# native code -----------------------------------------------------------------------------------------------------------


def native_libraries(artifacts: DataFrame) -> DataFrame:
    """(aid, lib, lib_ord, abi, machine, symbols, tables, notes) of libraries under lib/ and assets/; ``tables`` are their static registration entries."""

    def rows(data: bytes) -> Iterator[dict]:
        for e in zip.entries(data):
            if e.name.startswith(("lib/", "assets/")) and e.name.lower().endswith(".so"):
                folder = e.name.split("/")[1] if e.name.startswith("lib/") and e.name.count("/") > 1 else None
                row = {"lib": e.name, "lib_ord": e.entry_idx, "abi": folder}
                try:
                    if e.uncompressed_size > 64 << 20:
                        raise FormatError("over 64 MiB")
                    lib = elf.Elf(zip.read(data, e))
                    symbols = lib.exports()
                    tables, notes = lib.jni_tables()
                    yield row | {"machine": lib.machine, "symbols": symbols, "tables": [{"name": n, "signature": s} for n, s, _ in tables], "notes": notes}
                except FormatError as x:
                    yield row | {"error": str(x)}

    libs = per_artifact(artifacts, rows, "lib string, lib_ord int, abi string, machine string, symbols array<string>, tables array<struct<name:string,signature:string>>, notes array<string>")
    table = F.create_map(*[F.lit(x) for pair in S.ABI_MACHINES.items() for x in pair])
    expected = table[F.col("abi")]
    return libs.withColumn("abi_mismatch", F.coalesce(F.col("machine").isNotNull() & (expected != F.col("machine")), F.lit(False)))


def exports(libraries: DataFrame) -> DataFrame:
    return libraries.select("aid", "lib", F.explode("symbols").alias("symbol"))


def jni_entries(libraries: DataFrame) -> DataFrame:
    """(aid, lib, lib_ord, name, signature) of the static registration tables."""
    return libraries.select("aid", "lib", "lib_ord", F.explode("tables").alias("t")).select("aid", "lib", "lib_ord", "t.name", "t.signature").distinct()


def abi_split_missing(catalog, manifests_: DataFrame) -> DataFrame:
    """(aid) of packages without a library under lib/ whose manifest asks for splits: the code may lie in splits that aren't there."""
    asks = manifests_.where("error is null and required_splits").select("aid")
    has = catalog.table("zip_entry").where("name like 'lib/%' and name like '%.so'").select("aid").distinct()
    return asks.join(has, "aid", "left_anti").distinct()


# signing ---------------------------------------------------------------------------------------------------------------

CERT = "subject:string,issuer:string,serial:string,not_before:string,not_after:string,signature_algorithm:string,key_algorithm:string,sha256:string,sha1:string"


def signers(artifacts: DataFrame) -> DataFrame:
    """Signers of schemes v1 (certificates) and v2, v3, v3.1 (certificates and whether their content digests hold)."""

    def rows(data: bytes) -> Iterator[dict]:
        end = zip._end(data)
        central = struct.unpack_from("<I", data, end + 16)[0]
        for kind, value in signing.block_pairs(data, central):
            scheme = signing.PAIR_KINDS.get(kind)
            if scheme in ("v2", "v3", "v3.1"):
                start = signing.block_start(data, central)
                for k, s in enumerate(signing.signers(value, scheme != "v2")):
                    checks = []
                    for number, digest in s["digests"]:
                        known = signing.ALGORITHMS.get(number)
                        checks.append(None if known is None or known[0] == "verity" else signing.content_digest(data, start, central, end, known[1]) == digest)
                    verdict = "failed" if False in checks else "digest_ok" if True in checks else "unsupported"
                    yield {"scheme": scheme, "signer": k, "certs": [signing.certificate(c) for c in s["certs"]], "min_sdk": s["min_sdk"], "max_sdk": s["max_sdk"], "algorithms": ["-".join(signing.ALGORITHMS.get(n, ("unknown", hex(n)))) for n, _ in s["signatures"]], "verdict": verdict}
        k = 0
        for e in zip.entries(data):
            if e.name.upper().startswith("META-INF/") and e.name.count("/") == 1 and (e.name.upper().endswith((".RSA", ".DSA", ".EC")) or e.name.upper().startswith("META-INF/SIG-")):
                certs = signing.pkcs7_certificates(zip.read(data, e))
                yield {"scheme": "v1", "signer": k, "certs": [signing.certificate(c) for c in certs], "algorithms": [], "verdict": "unsupported"}
                k += 1

    return per_artifact(artifacts, rows, f"scheme string, signer int, certs array<struct<{CERT}>>, min_sdk long, max_sdk long, algorithms array<string>, verdict string")


def jar_coverage(artifacts: DataFrame, budget: int = 1 << 30) -> DataFrame:
    """Entries against META-INF/MANIFEST.MF: covered (and whether the digest holds), missing from the archive, or uncovered.

    Of entries with one name the first counts, and ``copies`` says how many there are.  Contents are digested while they fit the budget of unpacked bytes; one that
    doesn't fit is skipped (digest_ok is null) and later ones may fit.  ``sf_ok`` says whether the section's own digest in the signature file holds.
    """
    import hashlib

    def rows(data: bytes) -> Iterator[dict]:
        found: dict[str, zip.Entry] = {}
        copies: dict[str, int] = {}
        for e in zip.entries(data):
            found.setdefault(e.name, e)
            copies[e.name] = copies.get(e.name, 0) + 1
        if "META-INF/MANIFEST.MF" not in found:
            raise FormatError("no JAR manifest")
        signed: dict[str, tuple[str, bytes] | None] = {}
        for name, e in found.items():
            if name.upper().startswith("META-INF/") and name.upper().endswith(".SF") and name.count("/") == 1:
                for section, _ in signing.jar_sections(zip.read(data, e)):
                    if "Name" in section:
                        signed.setdefault(section["Name"], signing.jar_digest(section))
        left, named = budget, set()
        for section, raw in signing.jar_sections(zip.read(data, found["META-INF/MANIFEST.MF"])):
            name = section.get("Name")
            if name is None or name in named:
                continue
            named.add(name)
            digest, said, ok = signing.jar_digest(section), signed.get(name), None
            e = found.get(name)
            if e is not None and digest and e.uncompressed_size <= left:
                left -= e.uncompressed_size
                ok = hashlib.new(digest[0], zip.read(data, e)).digest() == digest[1]
            sf_ok = hashlib.new(said[0], raw).digest() == said[1] if said else None
            yield {"name": name, "status": "missing" if e is None else "covered", "digest_ok": ok, "sf_ok": sf_ok, "copies": copies.get(name, 0)}
        for name in found:
            if name not in named and not name.endswith("/") and not name.upper().startswith("META-INF/"):
                yield {"name": name, "status": "uncovered", "copies": copies[name]}

    return per_artifact(artifacts, rows, "name string, status string, digest_ok boolean, sf_ok boolean, copies int")


def scheme_agreement(signers_: DataFrame) -> DataFrame:
    """Do the schemes of an artifact name the same certificates: one row for each two schemes."""
    prints = signers_.where("error is null").select("aid", "scheme", F.explode("certs.sha256").alias("p")).groupBy("aid", "scheme").agg(F.array_sort(F.collect_set("p")).alias("prints"))
    a, b = prints.withColumnsRenamed({"scheme": "a", "prints": "pa"}), prints.withColumnsRenamed({"scheme": "b", "prints": "pb"})
    return a.join(b, "aid").where("a < b").select("aid", "a", "b", (F.col("pa") == F.col("pb")).alias("same"))


# containers ------------------------------------------------------------------------------------------------------------


def extract_entry(artifacts: DataFrame, name: str, verify: bool = False) -> DataFrame:
    """Content of one entry of every artifact, with a name that is safe to write."""

    def rows(data: bytes) -> Iterator[dict]:
        e = next((e for e in zip.entries(data) if e.name == name), None)
        if e is None:
            raise FormatError("no such entry")
        raw = zip.read(data, e, verify=verify)
        yield {"name": name, "content": raw, "crc_ok": zlib.crc32(raw) == e.crc32}

    return per_artifact(artifacts, rows, "name string, content binary, crc_ok boolean").withColumn("file_name", S.safe_basename(F.col("name")))


def members(artifacts: DataFrame, budget: int = 1 << 30) -> DataFrame:
    """Packages inside a container, with role from their manifest; stops where the running charge of sizes is over the budget."""

    def rows(data: bytes) -> Iterator[dict]:
        spent = 0
        for e in zip.entries(data):
            if not e.name.lower().endswith(".apk"):
                continue
            row = {"name": e.name, "ord": e.entry_idx, "size": e.uncompressed_size}
            spent += e.uncompressed_size + (e.compressed_size if e.method == zip.DEFLATED else 0)
            if spent > budget:
                yield row | {"error": "over the budget"}
                return
            try:
                inner = zip.read(data, e)
                found = zip.entries(inner)
                m = _entry(inner, "AndroidManifest.xml")
                info = axml.manifest(m) if m is not None else None
                abis = list(dict.fromkeys(x.name.split("/")[1] for x in found if x.name.startswith("lib/") and x.name.count("/") > 1))
                role = "unknown" if info is None else "split" if info["split"] else "base"
                yield row | {"role": role, "package": info and info["package"], "split": info and info["split"], "dex_count": len(zip.dex_entries(found)), "abis": abis, "libs": [x.name for x in found if x.name.endswith(".so")]}
            except FormatError as x:
                yield row | {"error": str(x)}

    return per_artifact(artifacts, rows, "name string, ord int, size long, role string, package string, split string, dex_count int, abis array<string>, libs array<string>").withColumn("lib_count", F.size("libs"))


def anomalies(dexes: DataFrame) -> DataFrame:
    """What is odd about DEX files: data behind the end, wrong checksum, wrong signature."""
    views = dexes.where("status = 'view'")
    odd = F.array(F.when(F.col("span") - F.col("data_end") > 65_536, "tail"), F.when(F.col("checksum") != F.col("adler"), "checksum"), F.when(F.col("sha1_ok") == 0, "signature"))
    return views.select("aid", "dx", F.explode(F.filter(odd, lambda x: x.isNotNull())).alias("anomaly"))


def _word(head: str, at: int) -> F.Column:
    """The little-endian 32-bit word at a byte of a binary column."""
    digits = F.hex(head)
    return F.conv(F.concat(*[F.substring(digits, 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long")


def artifact_anomalies(catalog, manifests_: DataFrame) -> DataFrame:
    """(aid, subject, anomaly) over whole artifacts: those of :func:`anomalies`, sizes that headers deny, bundles that lie about their length
    or version, packages that ask for splits, manifests of which no component has a class."""
    dexes = catalog.table("dex").where("status = 'view'")
    odd = anomalies(catalog.table("dex")).join(dexes.select("aid", "dx", F.col("dex_name").alias("subject")), ["aid", "dx"]).select("aid", "subject", "anomaly")
    entries = catalog.table("zip_entry").where("first_of_name = 1").select("aid", F.col("name").alias("entry_name"), F.col("uncompressed_size").alias("actual"))
    whole = catalog.table("artifact").where("input_kind = 'dex'").select("aid", F.col("size").alias("raw"))
    # the members of a container make up the file together
    said = dexes.groupBy("aid", "entry_name").agg(F.sum("file_size").alias("said")).join(entries, ["aid", "entry_name"], "left").join(whole, "aid", "left")
    sizes = said.where(F.col("said") != F.coalesce("actual", "raw")).select("aid", F.col("entry_name").alias("subject"), F.lit("size").alias("anomaly"))
    bundles = catalog.table("entry_sample").where("kind = 'hermes' and sample_bytes >= 36").join(catalog.table("zip_entry").select("aid", "entry_idx", "uncompressed_size"), ["aid", "entry_idx"])
    wrong = F.array(F.when(_word("head", 32) != F.col("uncompressed_size"), "bundle length"), F.when(_word("head", 8) > 10_000, "bundle version"))
    hermes_ = bundles.select("aid", F.col("name").alias("subject"), F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("anomaly"))
    split = abi_split_missing(catalog, manifests_).select("aid", F.lit("").alias("subject"), F.lit("splits").alias("anomaly"))
    parts = components(manifests_).where("kind <> 'activity-alias'")
    total = parts.groupBy("aid").agg(F.count(F.lit(1)).alias("total"))
    none = total.join(missing_components(parts, catalog.table("class_def")), "aid").where("missing = total").select("aid", F.lit("").alias("subject"), F.lit("components").alias("anomaly"))
    return odd.unionByName(sizes).unionByName(hermes_).unionByName(split).unionByName(none)


def inspect(catalog, manifests_: DataFrame) -> DataFrame:
    """One row for each artifact: what it is, its entries by kind, DEX files and how far they were read, package and split, packer, anomalies, and
    ``complete``: everything was read and every DEX ends where it says."""
    from dexlake.operators import dexquery as Q

    kinds = catalog.table("entry_sample").groupBy("aid", F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("aid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("entry_kinds"))
    dexes = catalog.table("dex").groupBy("aid").agg(F.count(F.lit(1)).alias("dex_count"), F.every((F.col("status") == "view") & F.col("data_end").isNotNull()).alias("whole"))
    odd = artifact_anomalies(catalog, manifests_).groupBy("aid").agg(F.array_sort(F.collect_set(F.concat_ws(": ", F.nullif("subject", F.lit("")), "anomaly"))).alias("anomalies"))
    info = manifests_.where("error is null").select("aid", "package", "split", "required_splits")
    report = Q.coverage(catalog).join(catalog.table("artifact").select("aid", "input_kind", "size", "entry_count"), "aid")
    for part in (kinds, dexes, info, Q.packers(catalog).select("aid", "packer"), odd):
        report = report.join(part, "aid", "left")
    return report.withColumns({"anomalies": F.coalesce("anomalies", F.array().cast("array<string>")), "dex_count": F.coalesce("dex_count", F.lit(0)), "complete": (F.col("coverage") == "complete") & F.coalesce("whole", F.lit(True))}).drop("whole")
