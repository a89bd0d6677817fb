"""Scalar expressions of the engine, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the class-file format: access flags in the order in which they are written.
ACCESS_FLAGS = [
    (0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x20, "synchronized"), (0x40, "volatile"),
    (0x80, "transient"), (0x100, "native"), (0x200, "interface"), (0x400, "abstract"), (0x800, "strictfp"), (0x1000, "synthetic"), (0x4000, "enum"),
]

# ELF machines and the library folders that belong to them.
ELF_MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "aarch64"}
ABI_MACHINES = {"armeabi": "arm", "armeabi-v7a": "arm", "arm64-v8a": "aarch64", "x86": "x86", "x86_64": "x86_64"}


def access_flags(flags: Column) -> Column:
    """Names of the flags that are set, separated by spaces."""
    return F.concat_ws(" ", *[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in ACCESS_FLAGS])


def class_kind(flags: Column) -> Column:
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    return F.when(has(0x2000), "annotation").when(has(0x200), "interface").when(has(0x4000), "enum").otherwise("class")


def normalize_descriptor(name: Column) -> Column:
    """A class name as a descriptor: dots become slashes, L and ; are put around it where they are missing."""
    dotted = F.replace(F.trim(name), F.lit("."), F.lit("/"))
    opened = F.when(dotted.startswith("L"), dotted).otherwise(F.concat(F.lit("L"), dotted))
    return F.when(opened.endswith(";"), opened).otherwise(F.concat(opened, F.lit(";")))


def normalize_prefix(prefix: Column) -> Column:
    """A class-name prefix as the beginning of a descriptor; one that already begins with L is left alone."""
    return F.when((prefix == "") | prefix.startswith("L"), prefix).otherwise(F.concat(F.lit("L"), F.replace(prefix, F.lit("."), F.lit("/"))))


def label(descriptor: Column, name: Column) -> Column:
    return F.concat(descriptor, F.lit("->"), name)


def jni_escape(text: Column) -> Column:
    """A name as JNI spells it in symbols: letters and digits stay, _ ; [ / have escapes, anything else is _0xxxx by UTF-16 unit."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def unit(n: Column) -> Column:
        return F.concat(F.lit("_0"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        over = code - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.floor(over / 1024)), unit(F.lit(0xDC00) + over % 1024))
        return F.when(c.rlike("^[A-Za-z0-9]$"), c).when(c == "/", "_").when(c == "_", "_1").when(c == ";", "_2").when(c == "[", "_3").when(code >= 0x10000, pair).otherwise(unit(code))

    return F.array_join(F.transform(chars, one), "")


def jni_names(descriptor: Column, name: Column, signature: Column) -> tuple[Column, Column]:
    """Short and long symbol of a native method; ``signature`` is the part between the parentheses."""
    inner = F.regexp_replace(descriptor, "^L|;$", "")
    short = F.concat(F.lit("Java_"), jni_escape(inner), F.lit("_"), jni_escape(name))
    return short, F.concat(short, F.lit("__"), jni_escape(signature))


def mask_control(text: Column) -> Column:
    """Control characters as middle dots."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", "·")


def component_class(package: Column, name: Column) -> Column:
    """Class of a manifest component: a leading dot, or no dot at all, is relative to the package."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~name.contains("."), F.concat(package, F.lit("."), name)).otherwise(name)


def scheme_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^([^:/?#]+)://", 1)


def host_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^[^:/?#]+://(?:[^/?#\\\\]*@)?([^:/?#\\\\]*)", 1)


def effective_exported(exported: Column, has_filter: Column, kind: Column, target_sdk: Column) -> tuple[Column, Column]:
    """Is a component exported, and how is that known: said, inferred as old platforms do, or missing where it is required."""
    said = exported.isNotNull()
    provider = kind == "provider"
    value = F.when(said, exported).when(provider, target_sdk < 17).otherwise(has_filter)
    state = F.when(said, "explicit").when(~provider & has_filter & (target_sdk >= 31), "missing_required").otherwise("legacy_inferred")
    return value, state


def safe_basename(path: Column) -> Column:
    """The last part of an entry's path, or null where that is no safe file name."""
    name = F.regexp_extract(path, "([^/\\\\]*)$", 1)
    return F.when((name != "") & ~name.isin(".", "..") & ~name.contains("\0") & ~name.contains(":"), name)


def resource_id(package: Column, type_: Column, entry: Column) -> Column:
    return F.shiftleft(package.cast("long"), 24).bitwiseOR(F.shiftleft(type_.cast("long"), 16)).bitwiseOR(entry.cast("long"))


def parse_resource_id(text: Column) -> Column:
    """0x… as a number, or null."""
    return F.when(text.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(text, 3, 8), 16, 10).cast("long"))


def magic_kind(head: Column) -> Column:
    """What the first bytes of an entry say it is."""
    # Leading bytes of the formats.
    starts = lambda x: F.startswith(head, F.unhex(F.lit(x)))
    return (
        F.when(starts("6465780A"), "dex").when(starts("504B0304"), "zip").when(starts("7F454C46"), "elf").when(starts("03000800"), "axml")
        .when(starts("02000C00"), "arsc").when(starts("C61FBC03C103191F"), "hermes").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpeg")
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def jni_name_ok(name: Column) -> Column:
    """Could this be the name of a Java method in a registration table?"""
    return (F.octet_length(name) <= 255) & name.rlike(r"^(?:[A-Za-z0-9_$-]|[^\x00-\x7F])+$")


def jni_signature_ok(signature: Column) -> Column:
    """Is this a whole method descriptor?"""
    field = r"\[*(?:[ZBSCIJFD]|L[^\x00-\x20(.\[;]+;)"
    return signature.rlike(rf"^\((?:{field})*\)(?:V|{field})$")
