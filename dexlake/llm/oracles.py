"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: crc32 of a text's UTF-8, unsigned: the table of bytes is made by the polynomial's rule.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"

_CRC_OF_TEXT = """xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def mixing_sql(shares: dict[str, int], other: str, other_share: int, block_bytes: int) -> str:
    """The Pfair schedule slot by slot: the state holds what each source has had in its phase and has left."""
    listed = ", ".join(f"({k}, '{s}', {a})" for k, (s, a) in enumerate({**shares, other: other_share}.items()))
    names = ", ".join(f"'{s}'" for s in shares)
    return f"""WITH RECURSIVE records AS (SELECT doc_id, CASE WHEN source IN ({names}) THEN source ELSE '{other}' END AS mix_source, greatest(strlen(coalesce(text, '')), 1) AS size FROM documents),
placed AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY mix_source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {block_bytes})::BIGINT AS block FROM records),
totals AS (SELECT v.k, v.s, v.a, ceil(sum(size) / {block_bytes})::BIGINT AS n FROM (VALUES {listed}) v(k, s, a) JOIN records ON mix_source = v.s GROUP BY ALL),
lists AS (SELECT list(s ORDER BY k) AS names, list(a ORDER BY k) AS a, list(n ORDER BY k) AS n, count(*) AS m FROM totals),
sim AS (SELECT 0::BIGINT AS slot, 0::BIGINT AS start, 0 AS phase, list_transform(n, lambda x: 0::BIGINT) AS had, n AS rest, NULL::BIGINT AS i, NULL::BIGINT AS block, NULL::BIGINT AS release, NULL::BIGINT AS deadline, 0 AS own FROM lists
UNION ALL SELECT slot + 1, CASE WHEN rest[i] = 1 THEN slot + 1 ELSE start END, phase + (rest[i] = 1)::INTEGER, list_transform(had, lambda h, j: CASE WHEN rest[i] = 1 THEN 0 WHEN j = i THEN h + 1 ELSE h END), list_transform(rest, lambda x, j: x - (j = i)::BIGINT), i, n[i] - rest[i], start + (had[i] * w) // a[i], start + best.due, phase
FROM (SELECT *, best.j AS i FROM (SELECT *, list_sort(list_filter(list_transform(range(1, m + 1), lambda j: CASE WHEN rest[j] > 0 AND (had[j] * w) // a[j] <= slot - start THEN {{'due': ((had[j] + 1) * w + a[j] - 1) // a[j], 'j': j}} END), lambda x: x IS NOT NULL))[1] AS best
FROM (SELECT slot, start, phase, had, rest, a, n, m, list_sum(list_transform(range(1, m + 1), lambda j: CASE WHEN rest[j] > 0 THEN a[j] ELSE 0 END)) AS w FROM sim, lists WHERE list_sum(rest) > 0))))
SELECT doc_id, mix_source, size::BIGINT AS size, placed.block, sim.own AS phase, release::BIGINT AS release, deadline::BIGINT AS deadline, (slot - 1)::BIGINT AS slot FROM placed JOIN sim ON sim.block = placed.block JOIN lists ON names[sim.i] = mix_source"""


OP5 = f"""WITH {_CRC_TABLE},
records AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, substr(md5(coalesce(text, '')), 1, 16) AS key, {_CRC_OF_TEXT} AS text_crc32 FROM documents, crc_table),
placed AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run, (SELECT sum(size) FROM records) AS total FROM records),
dealt AS (SELECT *, least(((2 * run - size) * 24) // (2 * total), 23)::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM dealt"""

OP10 = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = shared.a JOIN sizes y ON y.doc_id = shared.b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT reach.id, sides.b FROM reach JOIN sides ON sides.a = reach.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) r ON r.id = d.doc_id"""

OP6 = """WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT doc_id, unnest(range(n - 399)) AS s FROM raw WHERE n >= 400),
windows AS (SELECT starts.doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM starts JOIN raw ON raw.doc_id = starts.doc_id),
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
fresh AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS f FROM twice),
numbered AS (SELECT doc_id, s, sum(f) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM fresh),
runs AS (SELECT doc_id, r, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, r, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY r), 0) AS p, a, b FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY r) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT raw.doc_id, raw.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
decode(unhex(CASE WHEN kept IS NULL THEN h ELSE array_to_string(list_filter(regexp_extract_all(kept, '[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|..'), lambda c: len(c) > 2 OR c < '80'), '') END)) AS text FROM raw LEFT JOIN cut USING (doc_id)"""


SQL = {"op5_sharding": OP5, "op6_suffix_dedup": OP6, "op10_jaccard_join": OP10}


def queries_sql(shares: dict[str, int]) -> dict[str, str]:
    from dexlake.llm.mixing import BLOCK_BYTES, OTHER

    return {"op4_mixing": mixing_sql(shares, OTHER, 1, BLOCK_BYTES), **SQL}
