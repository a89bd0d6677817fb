"""Cross references, hierarchy, calls and listings over the catalog.

All of these are joins over integer keys (artifact, DEX, index).  Targets are filtered out of small pools first and joined
with the reference table by kind and index; who owns a body is joined last.  Results carry the ordinals that give their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexlake.functions import scalar as S
from dexlake.operators import relational as R
from dexlake.sources.artifacts import Catalog

KEY = ["aid", "dx"]
KINDS = ["string", "type", "field", "method"]


def descriptor_of(name: str) -> str:
    """A class name as a descriptor (the driver-side form of :func:`dexlake.functions.scalar.normalize_descriptor`)."""
    name = name.strip().replace(".", "/")
    name = name if name.startswith("L") else f"L{name}"
    return name if name.endswith(";") else f"{name};"


def _text_has(mutf8: str, text: str, needle: str) -> Column:
    """ASCII needles are looked for in the raw bytes, others in the decoded text."""
    if needle.isascii():
        return F.contains(F.col(mutf8), F.lit(needle.encode()))
    return F.col(text).contains(needle)


def _class_allowed(column: str, pattern: str, fuzzy: bool) -> Column:
    if not pattern:
        return F.lit(False)
    return F.col(column).contains(pattern) if fuzzy else F.col(column) == descriptor_of(pattern)


def targets(catalog: Catalog, kind: str, pattern: str = "", *, class_pattern: str | None = None, fuzzy_class: bool = False) -> DataFrame:
    """(aid, dx, ref_kind, ref_idx, label) of what a query asks for; an empty query has no targets."""
    if kind == "string":
        pool = catalog.table("string").where(_text_has("mutf8", "text", pattern) if pattern else F.lit(False))
        return pool.select(*KEY, F.lit("string").alias("ref_kind"), F.col("string_idx").alias("ref_idx"), F.col("text").alias("label"))
    if kind == "type":
        pool = catalog.table("type").where(F.col("descriptor").contains(pattern) if pattern else F.lit(False))
        return pool.select(*KEY, F.lit("type").alias("ref_kind"), F.col("type_idx").alias("ref_idx"), F.col("descriptor").alias("label"))
    if kind not in ("field", "method"):
        raise ValueError(f"no such kind: {kind}")
    pool = catalog.table(kind)
    wanted = F.lit(bool(pattern) or class_pattern is not None)
    if pattern:
        wanted = wanted & F.col("name").contains(pattern)
    if class_pattern is not None:
        wanted = wanted & _class_allowed("class_descriptor", class_pattern, fuzzy_class)
    return pool.where(wanted).select(*KEY, F.lit(kind).alias("ref_kind"), F.col(f"{kind}_idx").alias("ref_idx"), S.label(F.col("class_descriptor"), F.col("name")).alias("label"))


def owners(catalog: Catalog) -> DataFrame:
    """(aid, dx, code_off, method_idx, class_def_idx, list, ord, label, name, class_descriptor) of every method with a body."""
    methods = catalog.table("method").select(*KEY, "method_idx", "class_descriptor", "name", "signature", S.label(F.col("class_descriptor"), F.col("name")).alias("caller"))
    bodies = catalog.table("class_method").where("code_off <> 0").select(*KEY, "class_def_idx", "list", "ord", "method_idx", "code_off")
    return bodies.join(methods, [*KEY, "method_idx"])


def find_refs(catalog: Catalog, kind: str, pattern: str = "", **query) -> DataFrame:
    """(aid, dx, method_idx, caller, offset, matched, matched_text): each method that refers to a target, with all it refers to."""
    wanted = targets(catalog, kind, pattern, **query)
    refs = catalog.table("code_ref").where(F.col("ref_kind") == kind).select(*KEY, "code_off", "offset", "ref_kind", "ref_idx")
    # from targets to references, to the bodies that hold them, to the methods of these: each join takes what the last one left
    bodies = catalog.table("class_method").where("code_off <> 0").select(*KEY, "method_idx", "code_off")
    names = catalog.table("method").select(*KEY, "method_idx", S.label(F.col("class_descriptor"), F.col("name")).alias("caller"))
    hits = refs.join(wanted, [*KEY, "ref_kind", "ref_idx"]).join(bodies, [*KEY, "code_off"]).join(names, [*KEY, "method_idx"])
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("ref_kind"))
    return R.grouped_matches(hits, [*KEY, "method_idx", "caller"], "offset", F.struct(order.alias("k"), "ref_idx", "label"))


def search_report(hits: DataFrame, dexes: DataFrame) -> DataFrame:
    """Per DEX how many methods matched; DEXes without a match are there with 0."""
    counts = hits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("matched_methods"))
    return dexes.where("status = 'view'").select(*KEY, "dex_name").join(counts, KEY, "left").fillna(0, ["matched_methods"])


def report_lines(hits: DataFrame, dexes: DataFrame) -> DataFrame:
    """The text report: one line for each hit, ordered by DEX and method."""
    named = hits.join(dexes.select(*KEY, "dex_name"), KEY)
    return named.orderBy("aid", "dx", "method_idx").select(F.format_string("%s | %s | matched=(%s)", "dex_name", "caller", "matched_text").alias("value"))


def first_source_line(catalog: Catalog, hits: DataFrame) -> DataFrame:
    """Hits with the source line of their offset: of the debug rows with a positive line the first at that offset, else the last before it, else the
    first line of the method; null where the method has no debug rows."""
    body = [*KEY, "code_off"]
    rows = catalog.table("debug_line").select(*body, "ord", "pc", "line", "line_start")
    starts = rows.groupBy(*body).agg(F.greatest(F.max("line_start"), F.lit(1)).alias("_start"))
    # one row for each place: the first line said there holds at it, the last one from there on
    places = rows.where("line > 0").groupBy(*body, "pc").agg(F.struct("pc", F.min_by("line", "ord").alias("at"), F.max_by("line", "ord").alias("after")).alias("_place"))
    bodies = owners(catalog).select(*KEY, "method_idx", "code_off")
    placed = R.as_of(hits.join(bodies, [*KEY, "method_idx"], "left"), places, body, "offset", "pc", "_place", "pc")
    line = F.coalesce(F.when(F.col("_place.pc") == F.col("offset"), F.col("_place.at")).otherwise(F.col("_place.after")), F.col("_start"))
    return placed.join(starts, body, "left").select(*hits.columns, line.alias("line"))


def list_classes(catalog: Catalog, prefix: str = "") -> DataFrame:
    """Defined classes whose descriptor begins with a prefix, in file order."""
    if prefix and not prefix.startswith("L"):
        prefix = "L" + prefix.replace(".", "/")
    return catalog.table("class_def").where(F.col("descriptor").startswith(prefix)).select(*KEY, "class_def_idx", "descriptor", "access_flags", S.class_kind(F.col("access_flags")).alias("class_kind"))


def class_counts(catalog: Catalog, prefix: str = "") -> DataFrame:
    """Classes of each DEX that can be read, also where there are none."""
    counts = list_classes(catalog, prefix).groupBy(*KEY).agg(F.count(F.lit(1)).alias("classes"))
    return catalog.table("dex").where("status = 'view'").select(*KEY, "dex_name").join(counts, KEY, "left").fillna(0, ["classes"])


def list_methods(catalog: Catalog, class_name: str | None = None, name: str | None = None) -> DataFrame:
    """Declared methods by exact class and case-insensitive part of the name, in declaration order."""
    methods = catalog.table("method").select(*KEY, "method_idx", "class_descriptor", "name", "signature")
    if class_name is not None:
        methods = methods.where(F.col("class_descriptor") == descriptor_of(class_name))
    if name:
        methods = methods.where(F.lower("name").contains(name.lower()))
    declared = catalog.table("class_method").select(*KEY, "class_def_idx", "list", "ord", "method_idx", "access_flags")
    return declared.join(methods, [*KEY, "method_idx"]).withColumn("flags", S.access_flags(F.col("access_flags"))).withColumn("overload", F.concat("name", "signature"))


def list_strings(catalog: Catalog, pattern: str = "", limit: int | None = None) -> DataFrame:
    """The string pools, filtered on decoded text."""
    found = catalog.table("string").select(*KEY, "string_idx", "text")
    found = found.where(F.col("text").contains(pattern)) if pattern else found
    return found if limit is None else R.limit_with_total(found, limit, ["aid", "dx", "string_idx"])


def _class_bodies(catalog: Catalog, class_name: str, method: str | None = None) -> DataFrame:
    """Bodies of the first class definition with a descriptor in each DEX."""
    defined = catalog.table("class_def").where(F.col("descriptor") == descriptor_of(class_name)).select(*KEY, "class_def_idx")
    first = R.first_wins(defined, KEY, ["class_def_idx"])
    own = owners(catalog).join(first, [*KEY, "class_def_idx"], "left_semi")
    return own if method is None else own.where(F.col("name") == method)


def class_strings(catalog: Catalog, class_name: str) -> DataFrame:
    """Distinct strings that a class's code loads: how often, and their first place."""
    refs = catalog.table("code_ref").where("ref_kind = 'string'").join(_class_bodies(catalog, class_name), [*KEY, "code_off"])
    pool = catalog.table("string").select(*KEY, F.col("string_idx").alias("ref_idx"), "text")
    return refs.join(pool, [*KEY, "ref_idx"]).groupBy("aid", "text").agg(F.count(F.lit(1)).alias("sites"), F.min(F.struct("dx", "list", "ord", "offset")).alias("first_at"))


def call_edges(catalog: Catalog) -> DataFrame:
    """(aid, caller, callee, sites, ord): calls between methods as Lcls;->name, numbered for each caller by first place."""
    from pyspark.sql import Window

    refs = catalog.table("code_ref").where("ref_kind = 'method'").join(owners(catalog), [*KEY, "code_off"])
    called = catalog.table("method").select(*KEY, F.col("method_idx").alias("ref_idx"), S.label(F.col("class_descriptor"), F.col("name")).alias("callee"))
    edges = refs.select(*KEY, "code_off", "offset", "slot", "list", "ord", "caller", "ref_idx").join(called, [*KEY, "ref_idx"])
    edges = edges.groupBy("aid", "caller", "callee").agg(F.count(F.lit(1)).alias("sites"), F.min(F.struct("dx", "list", "ord", "offset", "slot")).alias("first_at"))
    return edges.withColumn("ord", F.row_number().over(Window.partitionBy("aid", "caller").orderBy("first_at"))).drop("first_at")


def callees(catalog: Catalog, class_name: str, method: str) -> DataFrame:
    """What a method calls, in order of first encounter."""
    return call_edges(catalog).where(F.col("caller") == f"{descriptor_of(class_name)}->{method}")


def call_tree(catalog: Catalog, aid: str, class_name: str, method: str, depth: int = 3, max_nodes: int = 200) -> DataFrame:
    """Calls below a method, breadth first; nodes repeat, ``max_nodes`` cuts in queue order."""
    edges = call_edges(catalog).where(F.col("aid") == aid).select("caller", "callee", "ord", "sites")
    root = catalog.wide.sparkSession.range(1).select(F.lit(f"{descriptor_of(class_name)}->{method}").alias("node"))
    return R.call_tree(root, edges, depth, max_nodes)


def subclasses(catalog: Catalog, class_name: str, *, transitive: bool = True) -> DataFrame:
    """(node, depth, via) of the classes that extend a class."""
    edges = catalog.table("class_def").where("super_descriptor is not null").select(F.col("descriptor").alias("child"), F.col("super_descriptor").alias("parent")).distinct()
    seed = catalog.wide.sparkSession.range(1).select(F.lit(descriptor_of(class_name)).alias("node"))
    return R.hierarchy(seed, edges, max_depth=None if transitive else 1)


def implementers(catalog: Catalog, interface: str, *, transitive: bool = True) -> DataFrame:
    """Classes that name an interface, and with ``transitive`` what extends or implements those."""
    named = catalog.table("class_interface").select(*KEY, "class_def_idx", F.col("descriptor").alias("parent")).join(catalog.table("class_def").select(*KEY, "class_def_idx", F.col("descriptor").alias("child"), "super_descriptor"), [*KEY, "class_def_idx"])
    direct = named.select("child", "parent").distinct()
    seed = catalog.wide.sparkSession.range(1).select(F.lit(descriptor_of(interface)).alias("node"))
    if not transitive:
        return R.hierarchy(seed, direct, max_depth=1)
    above = catalog.table("class_def").where("super_descriptor is not null").select(F.col("descriptor").alias("child"), F.col("super_descriptor").alias("parent"))
    return R.hierarchy(seed, direct.unionByName(above).distinct(), direct)


def defining_dex(catalog: Catalog, class_name: str) -> DataFrame:
    """The first DEX of each artifact that defines a class."""
    found = catalog.table("class_def").where(F.col("descriptor") == descriptor_of(class_name)).select("aid", "dx", "class_def_idx")
    return R.first_wins(found, ["aid"], ["dx", "class_def_idx"])


def package_tree(catalog: Catalog) -> DataFrame:
    """The tree of packages and classes of each defined class name; an inner class (after ``$``) is a node below its outer one."""
    inner = F.regexp_replace("descriptor", "^L+|;$", "")
    packages = F.slice(F.split(inner, "/"), 1, F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    classes = F.split(F.element_at(F.split(inner, "/"), -1), "\\$")
    return R.prefix_tree(catalog.table("class_def"), F.filter(F.concat(packages, classes), lambda x: x != ""))


def tree_filter(catalog: Catalog, needle: str) -> DataFrame:
    """Defined classes whose descriptor holds the needle, whatever the case of ASCII letters; an empty needle keeps all."""
    return catalog.table("class_def").where(S.ascii_lower(F.col("descriptor")).contains(S.ascii_lower(F.lit(needle)))).select(*KEY, "class_def_idx", "descriptor")


def hit_filter(hits: DataFrame, needle: str) -> DataFrame:
    """Hits of :func:`find_refs` whose caller or one of whose matches holds the needle, whatever the case of ASCII letters."""
    lower = S.ascii_lower(F.lit(needle))
    return hits.where(S.ascii_lower(F.col("caller")).contains(lower) | F.exists("matched", lambda m: S.ascii_lower(m).contains(lower)))


def native_methods(catalog: Catalog) -> DataFrame:
    """Declared native methods with their short and long symbols."""
    declared = list_methods(catalog).where(F.col("access_flags").bitwiseAND(F.lit(0x100)) != 0)
    short, long = S.jni_names(F.col("class_descriptor"), F.col("name"), F.regexp_extract("signature", "^\\((.*)\\)", 1))
    return declared.withColumn("short_name", short).withColumn("long_name", long)


def bind_exports(methods: DataFrame, exports: DataFrame) -> DataFrame:
    """Native methods with the libraries (aid, lib, symbol) that export their short or long symbol, sorted."""
    keys = ["aid", "dx", "class_def_idx", "list", "ord"]
    wanted = methods.select(*keys, F.explode(F.array("short_name", "long_name")).alias("symbol"))
    bound = wanted.join(exports.select("aid", "lib", "symbol").distinct(), ["aid", "symbol"]).groupBy(*keys).agg(F.array_sort(F.collect_set("lib")).alias("libs"))
    return methods.join(bound, keys, "left").withColumn("libs", F.coalesce("libs", F.array().cast("array<string>")))


def coverage(catalog: Catalog) -> DataFrame:
    """Was everything of an artifact read: complete, partial or unknown."""
    issues = catalog.table("issue").groupBy("aid").agg(F.max("failed").alias("failed"), F.slice(F.array_sort(F.collect_set("message")), 1, 100).alias("errors"))
    return catalog.table("artifact").join(issues, "aid", "left").select("aid", "path", F.when(F.col("input_kind") == "unknown", "unknown").when(F.coalesce("failed", F.lit(0)) == 1, "partial").otherwise("complete").alias("coverage"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def integrity(catalog: Catalog) -> DataFrame:
    """Checksums, sizes and what stands behind the data of each DEX."""
    return catalog.table("dex").where("status = 'view'").select(*KEY, "dex_name", "version", (F.col("checksum") == F.col("adler")).alias("checksum_ok"), (F.col("sha1_ok") == 1).alias("signature_ok"), "file_size", "data_end", (F.col("span") - F.col("data_end")).alias("tail_bytes"))


def bind_tables(methods: DataFrame, tables: DataFrame) -> DataFrame:
    """Native methods with the libraries (aid, lib, name, signature) whose static registration tables list them, in the order of the libraries."""
    keys = ["aid", "dx", "class_def_idx", "list", "ord"]
    listed = tables.groupBy("aid", "name", "signature", "lib").agg(F.min("lib_ord").alias("lib_ord"))
    bound = methods.select(*keys, "name", "signature").join(listed, ["aid", "name", "signature"]).groupBy(*keys)
    bound = bound.agg(F.transform(F.array_sort(F.collect_list(F.struct("lib_ord", "lib"))), lambda x: x["lib"]).alias("table_libs"))
    return methods.join(bound, keys, "left").withColumn("table_libs", F.coalesce("table_libs", F.array().cast("array<string>")))


def binding_counts(bound: DataFrame) -> DataFrame:
    """(aid, methods, by_name, by_table, unbound, note) of methods with ``libs`` and ``table_libs``."""
    named, listed = F.size("libs") > 0, F.size("table_libs") > 0
    counts = bound.groupBy("aid").agg(F.count(F.lit(1)).alias("methods"), F.count_if(named).alias("by_name"), F.count_if(listed).alias("by_table"), F.count_if(~named & ~listed).alias("unbound"))
    return counts.withColumn("note", F.when(F.col("unbound") == 0, None).when(F.col("unbound") == F.col("methods"), "all unbound").otherwise("some unbound"))


def packers(catalog: Catalog) -> DataFrame:
    """Artifacts with at least two of three signs of the packer: stub classes, a family of libraries among the assets, its name in a string."""
    stub = catalog.table("class_def").where(F.col("descriptor").rlike(r"^Lv([0-9a-f]+)/l\1(\$[^;]*)?;")).select("aid").distinct().withColumn("a", F.lit(1))
    # fixed value of the format: the architectures in the names of the family
    family = F.regexp_extract("name", r"^assets/l([0-9a-f]+_(?:a32|a64|x86|x64))\.so$", 1)
    assets = catalog.table("zip_entry").where(family != "").groupBy("aid").agg(F.count_distinct(family).alias("n")).where("n >= 2").select("aid", F.lit(1).alias("b"))
    named = catalog.table("string").where(F.col("text").contains("Virbox")).select("aid").distinct().withColumn("c", F.lit(1))
    joined = catalog.table("artifact").join(stub, "aid", "left").join(assets, "aid", "left").join(named, "aid", "left")
    n = F.size(F.filter(F.array("a", "b", "c"), lambda x: x.isNotNull()))
    return joined.select("aid", n.alias("signals"), F.when(n >= 2, "virbox").alias("packer"))
