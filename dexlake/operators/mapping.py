"""Name mappings of obfuscated builds: lines ``a.B -> x:`` and, indented below them, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse(lines: DataFrame, *, file_col: str = "file", line_col: str = "line_no", text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(classes, members) of numbered lines.

    A member belongs to the last class line before it; a line at the margin that is no class line ends that class.  Lines that can't be read are skipped.
    """
    text = F.col(text_col)
    is_member = text.rlike("^\\s")
    class_form, member_form = "^(\\S+) -> (\\S+):\\s*$", "^\\s+(?:\\d+:\\d+:)?(\\S+) ([^\\s(:]+)(\\([^)]*\\))?(?::\\d+)*(?::\\d+)? -> (\\S+)\\s*$"
    header = F.when(~is_member & (F.trim(text) != "") & ~text.startswith("#"), F.struct(F.nullif(F.regexp_extract(text, class_form, 1), F.lit("")).alias("original"), F.nullif(F.regexp_extract(text, class_form, 2), F.lit("")).alias("obfuscated")))
    own = Window.partitionBy(file_col).orderBy(line_col).rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("_c", F.last(header, ignorenulls=True).over(own))
    classes = carried.where(~is_member & F.col("_c.original").isNotNull() & text.rlike(class_form)).select(file_col, line_col, F.col("_c.original").alias("original"), F.col("_c.obfuscated").alias("obfuscated"))
    members = carried.where(is_member & F.col("_c.original").isNotNull() & text.rlike(member_form)).select(
        file_col, line_col, F.col("_c.original").alias("class_original"), F.col("_c.obfuscated").alias("class_obfuscated"),
        F.regexp_extract(text, member_form, 1).alias("type"), F.regexp_extract(text, member_form, 2).alias("original"), F.regexp_extract(text, member_form, 3).alias("parameters"), F.regexp_extract(text, member_form, 4).alias("obfuscated"),
    )
    return classes, members


def _has(column: str, needle: str):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(column, upper, lower).contains(needle)


def lookup(classes: DataFrame, members: DataFrame, needle: str) -> DataFrame:
    """Classes, then members, with the needle in a name (ASCII case doesn't matter); an empty needle finds nothing."""
    needle = "".join(c.lower() if c.isascii() else c for c in needle.strip())
    c = classes.where(_has("original", needle) | _has("obfuscated", needle)).select(F.lit(0).alias("section"), F.col("line_no").alias("ordinal"), "original", "obfuscated")
    m = members.where(_has("class_original", needle) | _has("class_obfuscated", needle) | _has("original", needle) | _has("obfuscated", needle))
    m = m.select(F.lit(1).alias("section"), F.col("line_no").alias("ordinal"), F.concat("class_original", F.lit("."), "original").alias("original"), F.concat("class_obfuscated", F.lit("."), "obfuscated").alias("obfuscated"))
    found = c.unionByName(m)
    return found if needle else found.limit(0)


def with_original_names(labels: DataFrame, classes: DataFrame, members: DataFrame, *, class_col: str, name_col: str) -> DataFrame:
    """Original class (the first line that names it) and original member names (all of them, joined by |) beside obfuscated ones."""
    first = classes.groupBy("obfuscated").agg(F.min_by("original", "line_no").alias("original_class"))
    every = members.groupBy("class_obfuscated", "obfuscated").agg(F.array_join(F.array_sort(F.collect_set("original")), "|").alias("original_member"))
    dotted = F.replace(F.regexp_replace(class_col, "^L|;$", ""), F.lit("/"), F.lit("."))
    out = labels.withColumn("_d", dotted)
    out = out.join(first.withColumnRenamed("obfuscated", "_d"), "_d", "left")
    return out.join(every.withColumnsRenamed({"class_obfuscated": "_d", "obfuscated": name_col}), ["_d", name_col], "left").drop("_d")
