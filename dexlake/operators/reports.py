"""Results as files and exit codes: text, JSON lines, and whether everything was read.

A command's result is its rows, the catalog's issues and whether the artifacts were wholly read; sinks write rows where an output committer can undo
what a lost task left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexlake.operators import dexquery as Q

# Fixed values of the contract: what a command ends with.
OK, NOT_FOUND, PARTIAL = 0, 1, 2


@dataclass
class Result:
    """Rows of a command, the issues of what it read, and whether that was all."""

    rows: DataFrame
    issues: DataFrame
    complete: bool

    def exit_code(self) -> int:
        """2 if something couldn't be read, else 1 if nothing was found, else 0."""
        if not self.complete:
            return PARTIAL
        return NOT_FOUND if self.rows.isEmpty() else OK


def result(catalog, rows: DataFrame) -> Result:
    issues = catalog.table("issue")
    return Result(rows, issues, issues.where("failed = 1").isEmpty())


def unreadable_dex(catalog) -> DataFrame:
    """Artifacts that are a DEX themselves and in which a DEX can't be read: (aid, path, message)."""
    raw = catalog.table("artifact").where("input_kind = 'dex'").select("aid", "path")
    failed = catalog.table("issue").where("failed = 1 and stage in ('magic', 'header')").select("aid", "message")
    return raw.join(failed, "aid").groupBy("aid", "path").agg(F.min("message").alias("message"))


def check_raw_dex(catalog) -> None:
    """Raise if an artifact that is a DEX itself can't be read."""
    if (bad := unreadable_dex(catalog).orderBy("path").first()) is not None:
        raise ValueError(f"{bad['path']}: {bad['message']}")


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def text_lines(catalog, hits: DataFrame) -> DataFrame:
    """The text report of a reference search."""
    return Q.report_lines(hits, catalog.table("dex"))


def write(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines (value) as text files of a folder, in order where they were sorted."""
    lines.select("value").write.mode(mode).text(path)
