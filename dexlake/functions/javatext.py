"""Signs of a failed decompilation in Java text: locals read before they are bound, catch bodies that repeat, loops whose test was copied into the body.

Texts are cut into words, marks and line ends first; comments and literals are left out there, so braces and names in them never count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the language and of the decompiler's names.
EXPRESSION_WORDS = frozenset({"return", "throw", "new", "else", "case", "do", "assert", "yield", "instanceof"})
STATEMENTS = frozenset({"if", "for", "while", "switch", "catch", "else", "do", "try", "synchronized"})
LEAVING = ("return", "throw", "break", "continue")
SHORTEST_BODY = 48
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|[A-Za-z_$][\w$]*|\n|\s|[^\s]""", re.DOTALL | re.ASCII)
_LOCAL = re.compile(r"v\d+_\d+")
_HEADER = re.compile(r"    \s*([\w$.,<>\[\]? ]*)\(.*\{\s*", re.ASCII)
_BINDING = re.compile(r"\s*(?:=(?!=)|[-+*/%&|^]=|\+\+|--)")


def tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of words, marks, line ends and literals; kind is the text itself of words and marks."""
    for m in _TOKEN.finditer(text):
        found = m.group()
        if found[:2] in ("//", "/*"):
            yield m.start(), m.end(), "comment"
        elif found[0] in "\"'":
            yield m.start(), m.end(), "literal"
        elif found == "\n" or not found.isspace():
            yield m.start(), m.end(), found


def _opens_method(line: str) -> bool:
    m = _HEADER.fullmatch(line)
    return m is not None and (m.group(1).split() or [""])[0] not in STATEMENTS


def unbound_locals(text: str) -> list[str]:
    """Names like v3_1 that a method reads before it binds them."""
    bound: set[tuple[int, str]] = set()
    found: set[str] = set()
    method, before = 0, None  # before: what could be a type, if a name follows
    for start, end, kind in tokens(text):
        if kind == "\n":
            stop = text.find("\n", end)
            if _opens_method(text[end : len(text) if stop < 0 else stop]):
                method, before = method + 1, None
        elif kind == "comment":
            before = before if text.startswith("//", start) else None
        elif kind == "literal":
            before = None
        elif kind[0].isalpha() or kind[0] in "_$":
            if _LOCAL.fullmatch(kind):
                if _BINDING.match(text, end) or (before is not None and before not in EXPRESSION_WORDS):
                    bound.add((method, kind))
                elif (method, kind) not in bound:
                    found.add(kind)
            before = kind
        else:
            before = "" if kind in "]>" else None
    return sorted(found)


def catch_bodies(text: str) -> list[str]:
    """Bodies of catch clauses of at least 48 characters, white space made even.  One inside another isn't counted by itself."""
    held = [t for t in tokens(text) if t[2] != "\n"]
    found, i = [], 0
    while i < len(held):
        if held[i][2] == "catch":
            opened = next((k for k in range(i + 1, len(held)) if held[k][2] == "{"), None)
            if opened is not None and any(held[k][2] == ")" for k in range(i + 1, opened)):
                depth, k = 0, opened
                while k < len(held):
                    depth += (held[k][2] == "{") - (held[k][2] == "}")
                    if not depth:
                        break
                    k += 1
                if k < len(held):
                    body = " ".join(text[held[opened][1] : held[k][0]].split())
                    if len(body) >= SHORTEST_BODY:
                        found.append(body)
                    i = k
        i += 1
    return found


def most_repeated(bodies: list[str]) -> int:
    """How often the most frequent body comes, 0 if none comes twice."""
    most = max(Counter(bodies).values(), default=0)
    return most if most > 1 else 0


def rotated_loops(text: str) -> int:
    """While loops whose body begins and ends with one and the same statement."""
    lines: list[str] = [line.strip() for line in text.split("\n")]
    change = [sum((k == "{") - (k == "}") for _, _, k in tokens(line)) for line in lines]
    hits = 0
    for i, line in enumerate(lines):
        if not (line.startswith("while (") and line.endswith("{")):
            continue
        depth, body = 1, []
        for own, d in zip(lines[i + 1 :], change[i + 1 :], strict=True):
            if depth == 1 and own.endswith(";"):
                body.append(own)
            depth += d
            if depth <= 0:
                break
            if depth > 1 and body and body[-1] is not None:
                body.append(None)
        if len(body) >= 3 and body[0] is not None and body[0] == body[-1] and not body[0].startswith(LEAVING):
            hits += 1
    return hits


def diagnosed(sources: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``sources`` with unbound_locals, repeated_catches (the largest group of equal catch bodies) and rotated_loops; null texts have none."""
    @F.pandas_udf("unbound_locals array<string>, repeated_catches int, rotated_loops int")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [(unbound_locals(t), most_repeated(catch_bodies(t)), rotated_loops(t)) if isinstance(t, str) else ([], 0, 0) for t in texts]
        return pd.DataFrame(rows, columns=["unbound_locals", "repeated_catches", "rotated_loops"])

    return sources.withColumn("_found", found(F.col(text_col))).select(*[F.col(f"`{c}`") for c in sources.columns], "_found.*")
