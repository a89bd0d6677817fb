"""Queries over the driver's tables: each applies an operator of the engine; SQL says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexlake.functions import scalar as S
from dexlake.operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT lang, min(doc_id) AS doc_id, string_agg(DISTINCT source, '; ' ORDER BY source) AS matched_text FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def findrefs_grouped(spark, d):
    docs = _t(spark, d, "documents").where("lang is not null")
    return R.grouped_matches(docs, ["lang"], "doc_id", F.struct(F.col("source").alias("label"))).select("lang", "doc_id", "matched_text")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_wins(spark, d):
    return R.first_wins(_t(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id)::BIGINT AS ordinal, (SELECT count(*) FROM documents WHERE lang = 'en')::BIGINT AS total, (SELECT count(*) > 100 FROM documents WHERE lang = 'en') AS truncated FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def limit_total(spark, d):
    docs = _t(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return R.limit_with_total(docs, 100, ["doc_id"]).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT source, doc_id, spent::BIGINT AS spent FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) WHERE spent <= 50000")
def inflate_budget(spark, d):
    return R.budget_prefix(_t(spark, d, "documents").select("source", "doc_id", "n_chars"), "n_chars", 50_000, ["source"], ["doc_id"]).select("source", "doc_id", "spent")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, length(props)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t AS (SELECT user_id, event_id, size, n, size <= 100 AS admitted, CASE WHEN size <= 100 THEN size ELSE 0 END AS spent FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.size, o.n, t.spent + o.size <= 100, CASE WHEN t.spent + o.size <= 100 THEN t.spent + o.size ELSE t.spent END FROM t JOIN o ON o.user_id = t.user_id AND o.n = t.n + 1)
SELECT user_id, event_id, size, admitted FROM t""")
def skipping_budget(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_id", F.length("props").cast("long").alias("size"))
    return R.skipping_budget(events, "size", 100, ["user_id"], ["event_id"])


@query("WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS s FROM pages), n AS (SELECT page_id, s, count(*) AS n FROM c WHERE s <> '' GROUP BY ALL), p AS (SELECT page_id, n / sum(n) OVER (PARTITION BY page_id) AS p FROM n) SELECT page_id, round(-sum(p * log2(p)), 3) AS entropy FROM p GROUP BY page_id")
def entropy(spark, d):
    return R.entropy(_t(spark, d, "pages").select("page_id", "url"), ["page_id"], F.filter(F.split("url", ""), lambda c: c != ""))


@query("SELECT page_id, sha256(url) AS sha256, sha1(url) AS sha1, length(html)::BIGINT AS chars, strlen(html)::BIGINT AS bytes FROM pages")
def digests(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("sha256"), F.sha1("url").alias("sha1"), F.length("html").cast("long").alias("chars"), F.octet_length("html").cast("long").alias("bytes"))


@query(r"SELECT page_id, regexp_extract(url, '^([^:/?#]+)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://(?:[^/?#\\]*@)?([^:/?#\\]*)', 1) AS host FROM pages")
def uri_split(spark, d):
    return _t(spark, d, "pages").select("page_id", S.scheme_of(F.col("url")).alias("scheme"), S.host_of(F.col("url")).alias("host"))


_CALLS = "SELECT DISTINCT user_id AS caller, user_id + length(event_type) AS callee, length(event_type) AS ord FROM events"


@query(f"""WITH RECURSIVE e AS ({_CALLS}), t AS (SELECT 1 AS depth, caller, callee FROM e WHERE caller = 8 UNION ALL SELECT t.depth + 1, e.caller, e.callee FROM t JOIN e ON e.caller = t.callee WHERE t.depth < 4)
SELECT depth::INTEGER AS depth, caller, callee, count(*)::BIGINT AS paths FROM t GROUP BY ALL""")
def call_tree(spark, d):
    edges = _t(spark, d, "events").select(F.col("user_id").alias("caller"), (F.col("user_id") + F.length("event_type")).alias("callee"), F.length("event_type").alias("ord")).distinct()
    roots = spark.range(1).select(F.lit(8).cast("long").alias("node"))
    return R.call_tree(roots, edges.withColumn("sites", F.lit(1).cast("long")), 4).groupBy("depth", "caller", "callee").agg(F.count(F.lit(1)).alias("paths"))


@query("SELECT p_partkey, concat_ws(' ', " + ", ".join(f"CASE WHEN (p_partkey & {b}) <> 0 THEN '{n}' END" for b, n in S.ACCESS_FLAGS) + ") AS flags FROM part")
def access_flags(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.access_flags(F.col("p_partkey")).alias("flags"))


@query("WITH f AS (SELECT source, lang, min(doc_id) AS o FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT source, string_agg(lang, ',' ORDER BY o, lang) AS pool_text FROM f GROUP BY source")
def pooled_dims(spark, d):
    return R.pooled(_t(spark, d, "documents").where("lang is not null"), ["source"], "lang", "doc_id").select("source", "pool_text")


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F]', '·', 'g') AS masked FROM documents")
def mask_control(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.mask_control(F.col("text")).alias("masked"))


_SEGMENTS = r"list_filter(string_split(regexp_replace(regexp_replace(url, '^[^:]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"


@query(f"WITH p AS (SELECT {_SEGMENTS} AS p FROM pages), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p) SELECT array_to_string(p[1:depth], '/') AS path, depth::INTEGER AS depth, count(*)::BIGINT AS entries FROM n GROUP BY ALL")
def package_tree(spark, d):
    bare = F.regexp_replace(F.regexp_replace("url", "^[^:]+://", ""), "[?#].*$", "")
    return R.prefix_tree(_t(spark, d, "pages"), F.filter(F.split(bare, "/"), lambda x: x != ""))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9]$') THEN c WHEN c = '/' THEN '_' WHEN c = '_' THEN '_1' WHEN c = ';' THEN '_2' WHEN c = '[' THEN '_3' ELSE '_0' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '') AS escaped FROM part")
def jni_escape(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.jni_escape(F.col("p_name")).alias("escaped"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 4 AS parent FROM part WHERE p_partkey > 0), t AS (SELECT child AS node, 1 AS depth, parent AS via FROM e WHERE parent = 1 UNION ALL SELECT e.child, t.depth + 1, e.parent FROM t JOIN e ON e.parent = t.node) SELECT node, depth::INTEGER AS depth, via FROM t")
def hierarchy_extends(spark, d):
    edges = _t(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 4").alias("parent"))
    return R.hierarchy(spark.range(1, 2).select(F.col("id").alias("node")), edges)


@query("""WITH RECURSIVE i AS (SELECT p_partkey AS child, (p_size % 7)::BIGINT AS parent FROM part WHERE p_partkey > 7), e AS (SELECT * FROM i UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey > 7),
t AS (SELECT DISTINCT child AS node, 1 AS depth FROM i WHERE parent = 3 UNION SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.node WHERE e.child <> 3), m AS (SELECT node, min(depth) AS depth FROM t GROUP BY node)
SELECT m.node, m.depth::INTEGER AS depth, min(CASE WHEN m.depth = 1 THEN 3 ELSE e.parent END)::BIGINT AS via FROM m JOIN e ON e.child = m.node LEFT JOIN m AS q ON q.node = e.parent AND q.depth = m.depth - 1 WHERE m.depth = 1 OR q.node IS NOT NULL GROUP BY ALL""")
def hierarchy_impl(spark, d):
    part = _t(spark, d, "part").where("p_partkey > 7")
    named = part.select(F.col("p_partkey").alias("child"), (F.col("p_size") % 7).cast("long").alias("parent"))
    edges = named.unionByName(part.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 4").alias("parent"))).distinct()
    return R.hierarchy(spark.range(3, 4).select(F.col("id").alias("node")), edges, named)


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) SELECT c.c_custkey, q.at, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM customer c CROSS JOIN (SELECT unnest([TIMESTAMP '1995-01-01', TIMESTAMP '1997-06-15']) AS at) q LEFT JOIN o ON o_custkey = c_custkey AND o_orderdate <= q.at GROUP BY ALL")
def asof_line(spark, d):
    times = F.array(F.lit("1995-01-01").cast("timestamp"), F.lit("1997-06-15").cast("timestamp"))
    asked = _t(spark, d, "customer").select(F.col("c_custkey"), F.explode(times).alias("at"))
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return R.as_of(asked, orders, ["c_custkey"], "at", "o_orderdate", "o_orderkey", "o_orderkey")


@query("WITH r AS (SELECT p_partkey AS region, p_partkey * 7 AS start, p_size AS n FROM part) SELECT region, count(*)::BIGINT AS hits, sum(l_orderkey)::BIGINT AS keys FROM lineitem JOIN r ON l_orderkey >= start AND l_orderkey < start + n GROUP BY region")
def range_region(spark, d):
    ranges = _t(spark, d, "part").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") * 7).alias("start"), F.col("p_size").alias("n"))
    points = _t(spark, d, "lineitem").select("l_orderkey")
    return R.in_ranges(points, ranges, "l_orderkey", "start", "n").groupBy("region").agg(F.count(F.lit(1)).alias("hits"), F.sum("l_orderkey").alias("keys"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'covered' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'uncovered' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def coverage_full_outer(spark, d):
    return R.coverage(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query("WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS e, o_custkey % 2 = 0 AS f, CASE WHEN o_orderkey % 3 = 0 THEN 'provider' ELSE 'activity' END AS k, (o_orderkey % 40)::INTEGER AS t FROM orders) SELECT o_orderkey, CASE WHEN e IS NOT NULL THEN e WHEN k = 'provider' THEN t < 17 ELSE f END AS exported, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN k <> 'provider' AND f AND t >= 31 THEN 'missing_required' ELSE 'legacy_inferred' END AS state FROM x")
def exported_state(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "provider").otherwise("activity")
    value, state = S.effective_exported(said, F.col("o_custkey") % 2 == 0, kind, (F.col("o_orderkey") % 40).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", value.alias("exported"), state.alias("state"))


@query("SELECT n_nationkey, unnest(generate_series(1, n_regionkey)) AS step FROM nation")
def rle_expand(spark, d):
    return R.expand_runs(_t(spark, d, "nation"), "n_regionkey").select("n_nationkey", "step")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def carry_forward(spark, d):
    return R.carry_forward(_t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked_at").select("conv_id", "turn", "asked_at")


