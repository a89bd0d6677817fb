"""Instructions, listings and control flow of method bodies.

Only decoding a body into instruction rows is Python; labels, references, blocks and edges are windows and joins over those rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dexlake.formats.binary import FormatError, u16, u32
from dexlake.formats.opcodes import FORMAT, KIND, NAMES, instructions
from dexlake.functions import scalar as S
from dexlake.operators.dexquery import KEY, owners
from dexlake.sources.artifacts import Catalog

INSN = "offset int, opcode int, width int, payload boolean, mnemonic string, operands string, ref_kind string, ref_idx long, targets array<int>, flow string, regs array<int>, literal long"

_REGISTER = re.compile(r"v(\d+)")


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> bits - 1 else value


def _hex(value: int) -> str:
    return f"{'-' if value < 0 else ''}0x{abs(value):x}"


def _registers(raw: bytes, at: int, form: str) -> list[str]:
    """Register operands of the common formats."""
    a = raw[at + 1]
    if form in ("12x", "22t", "22s", "22c", "22cs"):
        return [f"v{a & 15}", f"v{a >> 4}"]
    if form == "11n":
        return [f"v{a & 15}"]
    if form in ("11x", "21t", "21s", "21h", "21c", "31i", "31t", "31c", "51l"):
        return [f"v{a}"]
    if form == "22x":
        return [f"v{a}", f"v{u16(raw, at + 2)}"]
    if form == "32x":
        return [f"v{u16(raw, at + 2)}", f"v{u16(raw, at + 4)}"]
    if form == "23x":
        return [f"v{a}", f"v{raw[at + 2]}", f"v{raw[at + 3]}"]
    if form == "22b":
        return [f"v{a}", f"v{raw[at + 2]}"]
    if form in ("35c", "35mi", "35ms", "45cc"):
        n = a >> 4
        packed = u16(raw, at + 4)
        five = [packed & 15, packed >> 4 & 15, packed >> 8 & 15, packed >> 12, a & 15]
        return ["{" + ", ".join(f"v{r}" for r in five[: min(n, 5)]) + "}"]
    if form in ("3rc", "3rms", "4rcc"):
        first = u16(raw, at + 4)
        return [f"{{v{first} .. v{first + a - 1}}}" if a else "{}"]
    return []


def _numbers(words: list[str]) -> list[int]:
    """Register operands as numbers; a range is all of it."""
    found = [int(x) for w in words for x in _REGISTER.findall(w)]
    return list(range(found[0], found[1] + 1)) if words and ".." in words[0] else found


def _literal(raw: bytes, at: int, op: int, form: str) -> list[str]:
    if form == "11n":
        return [_hex(_signed(raw[at + 1] >> 4, 4))]
    if form in ("21s", "22s"):
        return [_hex(_signed(u16(raw, at + 2), 16))]
    if form == "21h":
        return [_hex(_signed(u16(raw, at + 2) << (48 if op == 0x19 else 16), 64 if op == 0x19 else 32))]
    if form == "31i":
        return [_hex(_signed(u32(raw, at + 2), 32))]
    if form == "22b":
        return [_hex(_signed(raw[at + 3], 8))]
    if form == "51l":
        return [_hex(struct.unpack_from("<q", raw, at + 2)[0])]
    return []


def _targets(raw: bytes, offset: int, op: int, form: str) -> list[int]:
    """Where a branch or switch may go."""
    at = offset * 2
    if form == "10t":
        return [offset + _signed(raw[at + 1], 8)]
    if form in ("20t", "21t", "22t"):
        return [offset + _signed(u16(raw, at + 2), 16)]
    if form == "30t":
        return [offset + _signed(u32(raw, at + 2), 32)]
    if op in (0x2B, 0x2C):
        p = (offset + _signed(u32(raw, at + 2), 32)) * 2
        n = u16(raw, p + 2)
        first = p + 8 if op == 0x2B else p + 4 + 4 * n
        return [offset + _signed(u32(raw, first + 4 * k), 32) for k in range(n)]
    return []


def decoded(raw: bytes) -> Iterator[dict]:
    """Instruction rows of a body; an unreadable rest ends them."""
    try:
        for offset, op, width, payload in instructions(raw):
            form = "" if payload else FORMAT[op]
            try:
                targets = [] if payload else _targets(raw, offset, op, form)
            except (FormatError, struct.error):
                targets = []
            kind = None if payload else KIND.get(op)
            regs, literal = ([], []) if payload else (_registers(raw, offset * 2, form), _literal(raw, offset * 2, op, form))
            words = regs + literal
            flow = "switch" if op in (0x2B, 0x2C) else "goto" if form in ("10t", "20t", "30t") else "if" if form in ("21t", "22t") else "return" if 0x0E <= op <= 0x11 else "throw" if op == 0x27 else "next"
            yield {"offset": offset, "opcode": op, "width": width, "payload": payload, "mnemonic": ".payload" if payload else NAMES.get(op, f"op-{op:02x}"), "operands": ", ".join(words), "ref_kind": kind, "ref_idx": None if kind is None else (u32 if op == 0x1B else u16)(raw, offset * 2 + 2), "targets": targets, "flow": "data" if payload else flow, "regs": _numbers(regs), "literal": int(literal[0], 16) if literal else None}
    except FormatError:
        return


def instruction_rows(bodies: DataFrame) -> DataFrame:
    """(aid, dx, code_off, …) of every instruction of code_item rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"aid string, dx int, code_off long, {INSN}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for b in batch.to_pylist():
                rows += [{"aid": b["aid"], "dx": b["dx"], "code_off": b["code_off"]} | r for r in decoded(b["insns"] or b"")]
                if len(rows) > 8192:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return bodies.select("aid", "dx", "code_off", "insns").mapInArrow(run, schema)


def references(catalog: Catalog, insns: DataFrame) -> DataFrame:
    """Instructions with what they refer to spelled out."""
    pools = [
        catalog.table("string").select(*KEY, F.lit("string").alias("ref_kind"), F.col("string_idx").alias("ref_idx"), F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')).alias("shown")),
        catalog.table("type").select(*KEY, F.lit("type").alias("ref_kind"), F.col("type_idx").alias("ref_idx"), F.col("descriptor").alias("shown")),
        catalog.table("field").select(*KEY, F.lit("field").alias("ref_kind"), F.col("field_idx").alias("ref_idx"), F.concat(S.label(F.col("class_descriptor"), F.col("name")), F.lit(":"), "type_descriptor").alias("shown")),
        catalog.table("method").select(*KEY, F.lit("method").alias("ref_kind"), F.col("method_idx").alias("ref_idx"), F.concat(S.label(F.col("class_descriptor"), F.col("name")), "signature").alias("shown")),
    ]
    every = pools[0]
    for p in pools[1:]:
        every = every.unionByName(p)
    return insns.join(every, [*KEY, "ref_kind", "ref_idx"], "left")


def listing(catalog: Catalog, class_name: str | None = None) -> DataFrame:
    """(aid, dx, caller, signature flags, text): a smali-like listing of every method with a body."""
    bodies = catalog.table("code_item")
    own = owners(catalog).join(catalog.table("class_method").select(*KEY, "class_def_idx", "list", "ord", "access_flags"), [*KEY, "class_def_idx", "list", "ord"])
    if class_name is not None:
        from dexlake.operators.dexquery import descriptor_of

        own = own.where(F.col("class_descriptor") == descriptor_of(class_name))
        bodies = bodies.join(own.select(*KEY, "code_off").distinct(), [*KEY, "code_off"], "left_semi")
    named = references(catalog, instruction_rows(bodies)).where("not payload")
    line = F.concat_ws(" ", "mnemonic", F.concat_ws(", ", F.nullif("operands", F.lit("")), "shown", F.array_join(F.transform("targets", lambda t: F.concat(F.lit(":l_"), F.lower(F.hex(t)))), ", ")))
    lines = named.groupBy(*KEY, "code_off").agg(F.array_sort(F.collect_list(F.struct("offset", F.rtrim(F.regexp_replace(line, ", $", "")).alias("line")))).alias("rows"), F.array_distinct(F.flatten(F.collect_list("targets"))).alias("marks"))
    body = F.transform("rows", lambda r: F.concat(F.when(F.array_contains("marks", r["offset"]), F.concat(F.lit(":l_"), F.lower(F.hex(r["offset"])), F.lit("\n"))).otherwise(""), F.lit("    "), r["line"]))
    head = F.concat(F.lit(".method "), S.access_flags(F.col("access_flags")), F.lit(" "), "name", "signature", F.lit("\n"))
    return own.join(lines, [*KEY, "code_off"]).select(*KEY, "class_def_idx", "list", "ord", "caller", F.concat(head, F.array_join(body, "\n"), F.lit("\n.end method")).alias("text"))


def blocks(insns: DataFrame, tries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of bodies: blocks begin at 0, at targets, behind branches and at handlers; edges are next, branch and exception."""
    own = [*KEY, "code_off"]
    code = insns.where("not payload")
    w = Window.partitionBy(*own).orderBy("offset")
    aims = code.select(*own, F.explode("targets").alias("offset"))
    if tries is not None:
        aims = aims.unionByName(tries.select(*own, F.col("addr").cast("int").alias("offset")))
    marked = code.join(aims.distinct().withColumn("aim", F.lit(True)), [*own, "offset"], "left")
    marked = marked.withColumn("leader", F.col("aim").isNotNull() | (F.coalesce(F.lag("flow").over(w), F.lit("start")) != "next"))
    numbered = marked.withColumn("block", F.sum(F.col("leader").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    made = numbered.groupBy(*own, "block").agg(F.min("offset").alias("start"), F.max(F.struct("offset", "width", "flow", "targets")).alias("last"), F.count(F.lit(1)).alias("instructions"))
    made = made.select(*own, "block", "start", (F.col("last.offset") + F.col("last.width")).alias("end"), F.col("last.flow").alias("flow"), F.col("last.targets").alias("targets"), "instructions")
    begins = made.select(*own, F.col("start").alias("at"), F.col("block").alias("to"))
    falls = made.where(F.col("flow").isin("next", "if", "switch")).select(*own, "block", F.col("end").alias("at"), F.lit("next").alias("kind"))
    jumps = made.select(*own, "block", F.explode(F.array_distinct("targets")).alias("at"), F.lit("branch").alias("kind"))
    ways = falls.unionByName(jumps)
    if tries is not None:
        held = made.join(tries.select(*own, F.col("start").alias("t0"), "count", F.col("addr").cast("int").alias("at")), own).where((F.col("start") < F.col("t0") + F.col("count")) & (F.col("end") > F.col("t0")))
        ways = ways.unionByName(held.select(*own, "block", "at", F.lit("exception").alias("kind")).distinct())
    return made.drop("targets"), ways.join(begins, [*own, "at"]).select(*own, F.col("block").alias("from"), "to", "kind")
