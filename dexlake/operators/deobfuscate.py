"""Strings that a build-time obfuscator hid behind calls of a decoder with a 64-bit id: finding decoders, their chunks and calls, and decoding.

The decoder draws from a small generator of 16-bit words, seeded by the lower half of the id; the text's place in the chunks, its length and each character are
XORed with draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexlake.formats.binary import utf16_units

# Fixed values of the obfuscator: multipliers of the seed, rotations and shift of the generator, characters in a chunk.
SEED_MULTIPLIERS = (0x62A9D9ED799705F5, 0xCB24D0A5C88C35B3)
ROTATIONS, SHIFT, CHUNK_LENGTH = (9, 13, 10), 5, 0x1FFF
_64 = (1 << 64) - 1


def _short(x: int) -> int:
    x &= 0xFFFF
    return x - 0x10000 if x & 0x8000 else x


def _turn(x: int, k: int) -> int:
    """A signed 16-bit word, widened to 32 bits, turned left there and cut to 16 bits again."""
    wide = x & 0xFFFFFFFF
    return _short(wide << k | wide >> 32 - k)


class Draws:
    """The generator: a state of 64 bits whose third word is the draw."""

    def __init__(self, seed: int):
        z = (seed ^ seed >> 33) * SEED_MULTIPLIERS[0] & _64
        self.state = ((z ^ z >> 28) * SEED_MULTIPLIERS[1] & _64) >> 32

    def next(self) -> int:
        a, b = _short(self.state), _short(self.state >> 16)
        word = _short(_turn(_short(a + b), ROTATIONS[0]) + a)
        b = _short(b ^ a)
        a, b = _short(_turn(a, ROTATIONS[1]) ^ b ^ b << SHIFT), _turn(b, ROTATIONS[2])
        self.state = (((word << 16 | b) << 16) | a) & _64
        return self.state

    def mix(self, unit: int) -> int:
        """A draw XORed with a character; the XOR stays in the state."""
        self.state = self.next() ^ unit << 32
        return self.state >> 32 & 0xFFFF


def _place(draws: Draws) -> int:
    low = draws.next() >> 32 & 0xFFFF
    return low ^ draws.next() >> 16 & 0xFFFF0000


def reveal(number: int, chunks: Sequence[str] | Sequence[Sequence[int]]) -> str | None:
    """The text behind an id, or None where it doesn't lie in the chunks (texts, or their UTF-16 units)."""
    draws = Draws(number & 0xFFFFFFFF)
    at = (number >> 32 ^ _place(draws)) & 0xFFFFFFFF
    at = at - (1 << 32) if at >> 31 else at

    def unit(i: int) -> int:
        c, k = divmod(i, CHUNK_LENGTH)
        if i < 0 or c >= len(chunks) or k >= len(chunks[c]):
            raise IndexError(i)
        found = chunks[c][k]
        return ord(found) if isinstance(found, str) else int(found)

    try:
        length = draws.mix(unit(at))
        units = [draws.mix(unit(at + 1 + i)) for i in range(length)]
    except IndexError:
        return None
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "surrogatepass")


def hide(texts: Sequence[str], seed: int = 1) -> tuple[list[int], list[str]]:
    """Ids and chunks from which :func:`reveal` gives the texts back."""
    ids, stream = [], []
    for k, text in enumerate(texts):
        low = (seed + k * 0x9E3779B9) & 0xFFFFFFFF
        draws = Draws(low)
        number = (len(stream) ^ _place(draws)) << 32 | low
        raw = text.encode("utf-16-le", "surrogatepass")
        for unit in [len(raw) // 2, *(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2))]:
            wanted = draws.next() >> 32 & 0xFFFF ^ unit
            draws.state ^= wanted << 32
            stream.append(chr(wanted))
        ids.append(number)
    return ids, ["".join(stream[i : i + CHUNK_LENGTH]) for i in range(0, len(stream), CHUNK_LENGTH)]


def revealed(ids: Column, chunks: Column) -> Column:
    """Texts of a column of ids (long) with a column of chunks (arrays of UTF-16 units: a chunk may hold lone surrogates)."""
    import pandas as pd

    def each(numbers: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or n != n or c is None else reveal(int(n) & _64, list(c)) for n, c in zip(numbers, held, strict=True)], dtype="object")

    return F.pandas_udf(each, "string", F.PandasUDFType.SCALAR)(ids, chunks)


def with_revealed(hits: DataFrame, decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits of a search with decoded texts behind their matches, each text once."""
    texts = decoded.groupBy(*keys).agg(F.array_sort(F.collect_set("text")).alias("_texts"))
    out = hits.join(texts, list(keys), "left").withColumn("matched", F.array_distinct(F.concat("matched", F.coalesce("_texts", F.array().cast("array<string>")))))
    return out.drop("_texts").withColumn("matched_text", F.array_join("matched", "; "))


# finding decoders and calls --------------------------------------------------------------------------------------------

# Fixed values of the formats: descriptors, and the opcodes that carry strings into an array and an array into a field.
STRING, STRINGS = "Ljava/lang/String;", "[Ljava/lang/String;"
DECODER, HELPER = f"(J){STRING}", f"(J{STRINGS}){STRING}"
STATIC, MOST_CHUNKS = 8, 65_536
CONST, CONST_WIDE, CONST_STRING = (0x12, 0x13, 0x14, 0x15), (0x16, 0x17, 0x18, 0x19), (0x1A, 0x1B)
MOVE_OBJECT, MOVE_RESULT, NEW_ARRAY, FILLED, PUT_ITEM, GET_STATIC, PUT_STATIC = (0x07, 0x08, 0x09), 0x0C, 0x23, (0x24, 0x25), 0x4D, 0x62, 0x69
INVOKE_STATIC = (0x71, 0x77)


def stored_chunks(rows: Sequence[dict], field: int, array_types: Sequence[int], strings: dict[int, bytes]) -> list[bytes] | None:
    """The array of strings that straight-line code stores in a field, or None if it isn't wholly known.

    ``rows`` are instructions (opcode, regs, literal, ref_idx, payload) in order.  A register holds a number, a string, an array or nothing known;
    an instruction that isn't followed makes its registers unknown.
    """
    held: dict[int, tuple] = {}
    stored: list | None = None
    made: list | None = None
    for r in rows:
        if r["payload"]:
            continue
        op, regs, ref = r["opcode"], r["regs"], r["ref_idx"]
        result, made = made, None
        value: tuple | None = None
        if op in CONST:
            value = ("number", r["literal"])
        elif op in CONST_STRING:
            value = ("string", ref)
        elif op in MOVE_OBJECT:
            value = held.get(regs[1])
        elif op == MOVE_RESULT:
            value = None if result is None else ("array", result)
        elif op == NEW_ARRAY and ref in array_types:
            size = held.get(regs[1])
            if size and size[0] == "number" and 0 <= size[1] <= MOST_CHUNKS:
                value = ("array", [None] * size[1])
        elif op in FILLED and ref in array_types:
            items = [held.get(x) for x in regs]
            if all(x and x[0] == "string" for x in items):
                made = [x[1] for x in items]
            continue
        elif op == PUT_ITEM:
            item, array, at = (held.get(x) for x in regs)
            if item and array and at and (item[0], array[0], at[0]) == ("string", "array", "number") and 0 <= at[1] < len(array[1]):
                array[1][at[1]] = item[1]
            continue
        elif op == PUT_STATIC and ref == field and r["ref_kind"] == "field":
            array = held.get(regs[0])
            stored = array[1] if array and array[0] == "array" else None
            continue
        elif op == GET_STATIC and ref == field:
            value = None if stored is None else ("array", stored)
        else:
            for x in regs:
                held.pop(x, None)
                held.pop(x + 1, None)
            continue
        if value is None:
            held.pop(regs[0], None)
        else:
            held[regs[0]] = value
    if stored is None or any(x is None or x not in strings for x in stored):
        return None
    return [strings[x] for x in stored]


def _bodies(catalog) -> DataFrame:
    """(aid, dx, class_def_idx, class_descriptor, name, signature, access_flags, code_off) of methods with a body."""
    methods = catalog.table("method").select("aid", "dx", "method_idx", "class_descriptor", "name", "signature")
    return catalog.table("class_method").where("code_off <> 0").select("aid", "dx", "class_def_idx", "method_idx", "access_flags", "code_off").join(methods, ["aid", "dx", "method_idx"])


def decoders(catalog) -> DataFrame:
    """(aid, dx, class_descriptor, name, chunks) of decoders: static, from a long to a string, reading one array of strings of their own class, with the
    generator's multiplier or a call of its helper; chunks (arrays of UTF-16 units) are what the class's initialiser stores in that array."""
    from dexlake.operators.disasm import instruction_rows

    body = ["aid", "dx", "code_off"]
    pool = ["aid", "dx", "ref_idx"]
    everything = _bodies(catalog)
    getters = everything.where((F.col("signature") == DECODER) & (F.col("access_flags").bitwiseAND(F.lit(STATIC)) != 0))
    code = instruction_rows(catalog.table("code_item").join(getters.select(*body).distinct(), body, "left_semi"))
    fields = catalog.table("field").where(F.col("type_descriptor") == STRINGS).select("aid", "dx", F.col("field_idx").alias("ref_idx"), F.col("class_descriptor").alias("owner"))
    read = code.where(F.col("opcode") == GET_STATIC).join(fields, pool).groupBy(*body).agg(F.collect_set("ref_idx").alias("fields"), F.first("owner").alias("owner")).where(F.size("fields") == 1)
    helpers = catalog.table("method").where(F.col("signature") == HELPER).select("aid", "dx", F.col("method_idx").alias("ref_idx"))
    seed = SEED_MULTIPLIERS[0] - (1 << 64) if SEED_MULTIPLIERS[0] >> 63 else SEED_MULTIPLIERS[0]
    marked = code.where((F.col("opcode") == CONST_WIDE[2]) & (F.col("literal") == seed)).select(*body)
    marked = marked.unionByName(code.where(F.col("opcode").isin(*INVOKE_STATIC)).join(helpers, pool, "left_semi").select(*body)).distinct()
    found = getters.join(read, body).where("owner = class_descriptor").join(marked, body, "left_semi").select("aid", "dx", "class_def_idx", "class_descriptor", "name", F.element_at("fields", 1).alias("field"))

    starts = everything.where("name = '<clinit>'").select("aid", "dx", "class_def_idx", "code_off").join(found.select("aid", "dx", "class_def_idx").distinct(), ["aid", "dx", "class_def_idx"], "left_semi")
    insns = instruction_rows(catalog.table("code_item").join(starts.select(*body).distinct(), body, "left_semi"))
    held = ("offset", "opcode", "regs", "literal", "ref_kind", "ref_idx", "payload")
    # one initialiser is one row: as long as a method may be
    gathered = insns.groupBy(*body).agg(F.sort_array(F.collect_list(F.struct(*held))).alias("rows"))
    texts = catalog.table("string").select("aid", "dx", F.col("string_idx").alias("ref_idx"), "mutf8")  # the bytes: a chunk may hold half a pair
    loaded = insns.where("ref_kind = 'string'").select(*body, "ref_idx").distinct().join(texts, pool).groupBy(*body).agg(F.map_from_entries(F.collect_list(F.struct("ref_idx", "mutf8"))).alias("strings"))
    arrays = catalog.table("type").where(F.col("descriptor") == STRINGS).groupBy("aid", "dx").agg(F.collect_list("type_idx").alias("arrays"))
    inputs = found.join(starts, ["aid", "dx", "class_def_idx"]).join(gathered, body).join(loaded, body, "left").join(arrays, ["aid", "dx"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chunks = stored_chunks(row["rows"], row["field"], row["arrays"], dict(row["strings"] or ()))
                if chunks is not None:
                    out.append({k: row[k] for k in ("aid", "dx", "class_descriptor", "name")} | {"chunks": [utf16_units(c) for c in chunks]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("aid", pa.string()), ("dx", pa.int32()), ("class_descriptor", pa.string()), ("name", pa.string()), ("chunks", pa.list_(pa.list_(pa.int32())))]))

    return inputs.select("aid", "dx", "class_descriptor", "name", "field", "rows", "strings", "arrays").mapInArrow(run, "aid string, dx int, class_descriptor string, name string, chunks array<array<int>>")


def decoded_calls(catalog, found: DataFrame) -> DataFrame:
    """(aid, dx, code_off, offset, number, text): calls of decoders (of any DEX of the artifact) whose id is a constant of the same straight run of code.

    The id's registers are looked up as of the call: the last instruction that names one of them has to be the constant, with no place that
    can be jumped to behind it, up to and including the call.
    """
    from dexlake.operators import relational as R
    from dexlake.operators.disasm import instruction_rows

    body = ["aid", "dx", "code_off"]
    names = catalog.table("method").where(F.col("signature") == DECODER).select("aid", "dx", F.col("method_idx").alias("ref_idx"), "class_descriptor", "name")
    known = names.join(found.select("aid", "class_descriptor", "name", "chunks").dropDuplicates(["aid", "class_descriptor", "name"]), ["aid", "class_descriptor", "name"])
    refs = catalog.table("code_ref").where(F.col("opcode").isin(*INVOKE_STATIC)).join(known.select("aid", "dx", "ref_idx"), ["aid", "dx", "ref_idx"], "left_semi")
    code = instruction_rows(catalog.table("code_item").join(refs.select(*body).distinct(), body, "left_semi"))
    calls = code.where(F.col("opcode").isin(*INVOKE_STATIC) & (F.size("regs") == 2)).where(F.try_element_at("regs", F.lit(2)) == F.try_element_at("regs", F.lit(1)) + 1)
    calls = calls.join(known.select("aid", "dx", "ref_idx", "chunks"), ["aid", "dx", "ref_idx"])
    calls = calls.select(*body, "offset", (F.col("offset") - 1).alias("until"), F.element_at("regs", 1).alias("pair"), "chunks")
    plain = code.where("not payload")
    # an operand may be wide: register r touches the pairs that begin at r - 1, r and r + 1
    touched = plain.select(*body, "offset", "opcode", "literal", F.try_element_at("regs", F.lit(1)).alias("first"), F.explode("regs").alias("reg"))
    touched = touched.select(*body, "offset", "opcode", "literal", "first", F.explode(F.array(F.col("reg") - 1, F.col("reg"), F.col("reg") + 1)).alias("pair")).distinct()
    constant = F.when(F.col("opcode").isin(*CONST_WIDE) & (F.col("first") == F.col("pair")), F.col("literal"))
    touched = touched.select(*body, "pair", "offset", F.struct(F.col("offset").alias("at"), constant.alias("number")).alias("last"))
    calls = R.as_of(calls, touched, [*body, "pair"], "until", "offset", "last", "offset")
    leaders = code.select(*body, F.explode("targets").alias("offset")).unionByName(code.where("payload").select(*body, "offset"))
    leaders = leaders.unionByName(catalog.table("code_try").select(*body, F.col("addr").cast("int").alias("offset")).join(refs.select(*body).distinct(), body, "left_semi")).distinct()
    calls = R.as_of(calls, leaders.withColumn("leader", F.col("offset")), body, "offset", "offset", "leader", "offset")
    straight = calls.where(F.col("last.number").isNotNull() & (F.col("leader").isNull() | (F.col("leader") <= F.col("last.at"))))
    return straight.select(*body, "offset", F.col("last.number").alias("number"), revealed(F.col("last.number"), F.col("chunks")).alias("text")).where("text is not null")
