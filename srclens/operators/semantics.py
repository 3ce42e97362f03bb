"""Constant expressions, enum values, array bounds and NULL proofs over C facts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import functions, view
from .lines import diagnostics
from .intervals import owner

LIMIT = 10**38
NUMBER = re.compile(r"(0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)[uUlL]*\Z")
LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]


def literal(text: str) -> int | None:
    m = NUMBER.match(text)
    if m is None:
        return None
    t = m[1].lower()
    return int(t, 16) if t.startswith("0x") else int(t[2:], 2) if t.startswith("0b") else int(t, 8) if t.startswith("0") and t.isdigit() and set(t) <= set("01234567") else int(t) if not t.startswith("0") else None


def evaluate(text: str, names: dict[str, int]) -> int | None:
    """The value of an integer constant expression; None if it is none, divides by zero or leaves 38 digits."""
    words, at = text.split(), 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1]

    def unary() -> int:
        w = take()
        if w == "(":
            v = level(0)
            if take() != ")":
                raise ValueError
            return v
        if w in ("-", "+", "~", "!"):
            v = unary()
            return {"-": -v, "+": v, "~": ~v, "!": int(not v)}[w]
        v = names[w] if w in names else literal(w)
        if v is None:
            raise ValueError
        return v

    def level(k: int) -> int:
        if k == len(LEVELS):
            return unary()
        v = level(k + 1)
        while peek() in LEVELS[k]:
            op, r = take(), level(k + 1)
            if op in ("/", "%"):
                q = abs(v) // abs(r) * (1 if (v < 0) == (r < 0) else -1)
                v = q if op == "/" else v - q * r
            elif op in ("<<", ">>"):
                if not 0 <= r < 127:
                    raise ValueError
                v = v << r if op == "<<" else v >> r
            else:
                v = {"||": lambda: int(bool(v or r)), "&&": lambda: int(bool(v and r)), "|": lambda: v | r, "^": lambda: v ^ r, "&": lambda: v & r, "==": lambda: int(v == r), "!=": lambda: int(v != r), "<": lambda: int(v < r), ">": lambda: int(v > r), "<=": lambda: int(v <= r), ">=": lambda: int(v >= r), "+": lambda: v + r, "-": lambda: v - r, "*": lambda: v * r}[op]()
            if abs(v) >= LIMIT:
                raise ValueError
        return v

    try:
        v = level(0)
        return v if at == len(words) else None
    except (ValueError, IndexError, KeyError, ZeroDivisionError):
        return None


def enum_values(constants: list[tuple[str, str | None]], names: dict[str, int]) -> list[int | None]:
    """Values in order: explicit ones, else one more than the last; unknown ones stay unknown until the next explicit one."""
    out, last = [], -1
    for name, text in constants:
        v = evaluate(text, names) if text is not None else None if last is None else last + 1
        out.append(v)
        last = v
        if v is not None:
            names[name] = v
    return out


def array_class(bound: str | None, names: dict[str, int], macros: set[str]) -> str:
    if not bound:
        return "incomplete"
    v = evaluate(bound, names)
    if v is not None:
        return "constant" if v > 0 else "unknown"
    words = {w for w in bound.split() if re.match(r"[A-Za-z_]", w)}
    return "unknown" if words & macros or "sizeof" in words or not words else "variable"


def constants_and_arrays(facts: DataFrame) -> DataFrame:
    """(path, fact, name, line, start, end, value, class): enum constants with their value, arrays with their class; a file at a time."""
    kinds = facts.where(F.col("fact").isin("enum_constant", "array", "macro")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "line", "fact", "name", "owner", "text", "flag"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                macros = {r["name"] for r in rows if r["fact"] == "macro"}
                names = {r["name"]: v for r in rows if r["fact"] == "macro" and not r["flag"] and (v := evaluate(r["text"] or "", {})) is not None}
                enums: dict[str, list[dict]] = {}
                for r in rows:
                    if r["fact"] == "enum_constant":
                        enums.setdefault(r["owner"], []).append(r)
                for own in enums.values():
                    for r, v in zip(own, enum_values([(r["name"], r["text"]) for r in own], names), strict=True):
                        out.append((path, "enum_constant", r["name"], r["line"], r["start"], r["end"], None if v is None else str(v), None))
                for r in rows:
                    if r["fact"] == "array":
                        v = evaluate(r["text"] or "", names)
                        out.append((path, "array", r["name"], r["line"], r["start"], r["end"], None if v is None else str(v), array_class(r["text"], names, macros - names.keys())))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "fact", "name", "line", "start", "end", "value", "class"])

    out = kinds.mapInArrow(run, "path string, fact string, name string, line long, start long, `end` long, value string, class string")
    return out.withColumn("value", F.col("value").cast("decimal(38,0)"))


def vla_corrections(reported: DataFrame, arrays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reported VLAs (path, start) less those inside an array of constant bound, and an advisory for each of these."""
    constant = arrays.where("fact = 'array' AND class = 'constant'").select("path", "start", "end", "name")
    found = owner(reported, constant)
    wrong = found.where("owner is not null")
    return found.where("owner is null").drop("owner"), wrong.select("path", "start", F.lit("info").alias("severity"), F.lit("VLA_FALSE_POSITIVE").alias("rule_id"), F.col("owner").alias("message"))


def null_state(facts: DataFrame) -> DataFrame:
    """(path, start, provides): directives that define NULL, and those that take it away."""
    d = view(facts, "directive")
    gives = d.where(F.col("text").rlike(r"^# include < stddef \. h >$") | F.col("text").rlike(r"^# define NULL (0|\( \( void \* \) 0 \))$"))
    takes = d.where(F.col("text").rlike(r"^# undef NULL$") | (F.col("text").rlike(r"^# define NULL\b") & ~F.col("text").rlike(r"^# define NULL (0|\( \( void \* \) 0 \))$")))
    return gives.select("path", "start", F.lit(True).alias("provides")).unionByName(takes.select("path", "start", F.lit(False).alias("provides")))


def pointer_returns(facts: DataFrame) -> DataFrame:
    """(path, line, start, function, null_known): returns of 0 by functions that return pointers; whether NULL is known to be defined there."""
    own = functions(facts).where("kind = 'definition' AND returns_pointer").select("path", F.col("name").alias("function"))
    zero = view(facts, "return").where(F.col("text").rlike(r"^(\( )*0( \))*$")).select("path", "line", "start", F.col("owner").alias("function")).join(own.distinct(), ["path", "function"])
    both = zero.select("path", "start", F.lit(None).cast("boolean").alias("provides"), F.lit(1).alias("asks")).unionByName(null_state(facts).withColumn("asks", F.lit(0)))
    w = Window.partitionBy("path").orderBy("start", F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("null_known", F.coalesce(F.last("provides", True).over(w), F.lit(False))).where("asks = 1").select("path", "start", "null_known")
    return zero.join(known, ["path", "start"])


def zero_returns(facts: DataFrame) -> DataFrame:
    return diagnostics(pointer_returns(facts).where(~F.col("null_known")), "POINTER_ZERO_WITHOUT_NULL", "info", F.col("function"))
