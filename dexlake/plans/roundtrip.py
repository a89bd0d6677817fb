"""Queries that go through bytes: DEX files are built from rows of the driver's tables, parsed again, and asked.

Each chunk of parts becomes one DEX: class Lt/P<key>; extends Lt/P<key div 4>; and its method m loads the part's name and calls its parent's m.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexlake.operators import dexquery as Q
from dexlake.plans.built import once
from dexlake.plans.driver import query
from dexlake.plans.lineage import cut, folder
from dexlake.sources.artifacts import Catalog

CHUNK = 500


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """(aid, path, content): a DEX for each chunk of parts."""
    from dexlake.formats import synth

    parts = spark.read.parquet(f"{d}/part.parquet").select(F.expr(f"p_partkey div {CHUNK}").alias("chunk"), "p_partkey", "p_name")

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        classes = []
        for k, name in zip(rows["p_partkey"].to_pylist(), rows["p_name"].to_pylist(), strict=True):
            body = [("string", name or ""), ("call", (f"Lt/P{k // 4};", "m", "()V"))]
            classes.append(synth.Class(f"Lt/P{k};", parent=f"Lt/P{k // 4};" if k else "Ljava/lang/Object;", methods=[synth.Method("m", flags=9, body=body, virtual=False)]))
        chunk = key[0].as_py()
        return pa.table({"aid": [f"chunk{chunk}"], "path": [f"chunk{chunk}.dex"], "content": [synth.build(classes)]})

    return parts.groupBy("chunk").applyInArrow(built, "aid string, path string, content binary")


def _catalog(spark: SparkSession, d: str) -> Catalog:
    return once(spark, d, "chunks", lambda: Catalog.write(cut(_artifacts(spark, d)), folder(spark), mode="overwrite"))


def _key(column: str) -> F.Column:
    return F.regexp_extract(column, "^Lt/P(\\d+);", 1).cast("long")


@query("SELECT p_partkey AS caller, p_name AS matched_text FROM part WHERE contains(p_name, 'ring')")
def binary_findrefs(spark, d):
    return Q.find_refs(_catalog(spark, d), "string", "ring").select(_key("caller").alias("caller"), "matched_text")


@query("SELECT p_partkey AS caller, 'Lt/P' || (p_partkey // 4) || ';->m' AS matched_text FROM part WHERE p_partkey // 4 = 7")
def binary_findrefs_method(spark, d):
    return Q.find_refs(_catalog(spark, d), "method", "m", class_pattern="t.P7").select(_key("caller").alias("caller"), "matched_text")


@query("SELECT 'Lt/P' || p_partkey || ';' AS descriptor FROM part WHERE starts_with('Lt/P' || p_partkey || ';', 'Lt/P1')")
def dex_listclass(spark, d):
    return Q.list_classes(_catalog(spark, d), "t.P1").select("descriptor")


@query(f"SELECT DISTINCT p_partkey // {CHUNK} AS chunk, p_name AS text FROM part WHERE contains(p_name, 'hot')")
def dex_strings(spark, d):
    return Q.list_strings(_catalog(spark, d), "hot").select(F.expr("cast(substring(aid, 6) as long)").alias("chunk"), "text")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 4 AS parent FROM part WHERE p_partkey > 0), t AS (SELECT child AS node, 1 AS depth, parent AS via FROM e WHERE parent = 2 UNION ALL SELECT e.child, t.depth + 1, e.parent FROM t JOIN e ON e.parent = t.node) SELECT node, depth::INTEGER AS depth, via FROM t")
def dex_hierarchy(spark, d):
    return Q.subclasses(_catalog(spark, d), "t.P2").select(_key("node").alias("node"), "depth", _key("via").alias("via"))


@query("SELECT p_partkey AS caller, p_partkey // 4 AS callee, 1::BIGINT AS sites FROM part")
def dex_calls(spark, d):
    return Q.call_edges(_catalog(spark, d)).select(_key("caller").alias("caller"), _key("callee").alias("callee"), "sites")


@query("WITH RECURSIVE t AS (SELECT 1 AS depth, 130::BIGINT AS caller, 130 // 4 AS callee UNION ALL SELECT depth + 1, callee, callee // 4 FROM t WHERE depth < 5) SELECT depth::INTEGER AS depth, caller::BIGINT AS caller, callee::BIGINT AS callee FROM t")
def dex_call_tree(spark, d):
    tree = Q.call_tree(_catalog(spark, d), "chunk0", "t.P130", "m", depth=5)
    return tree.select("depth", _key("caller").alias("caller"), _key("callee").alias("callee"))


@query("SELECT p_partkey AS cls, 'm()V' AS overload, 'public static' AS flags FROM part WHERE p_partkey = 42")
def dex_listmethod(spark, d):
    return Q.list_methods(_catalog(spark, d), "t.P42", "M").select(_key("class_descriptor").alias("cls"), "overload", "flags")


@query(f"SELECT 'chunk' || (p_partkey // {CHUNK}) AS aid, true AS checksum_ok, true AS signature_ok, 0::BIGINT AS tail_bytes FROM part GROUP BY 1")
def dex_integrity(spark, d):
    return Q.integrity(_catalog(spark, d)).select("aid", "checksum_ok", "signature_ok", "tail_bytes")
