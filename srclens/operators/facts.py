"""Facts of C sources, read from their tokens by a tolerant declaration and statement scan.

One pass a file gives tagged rows (path, fact, name, owner, start, end, line, n,
flag, text); the functions below are views of them.  A file whose brackets don't
match or that holds unknown bytes gives the fact ``unsafe``, a fact ``recovery``
for each region that could not be read, and the facts of all others: of
conditional arms the first is read, and a file that still doesn't match is read
in parts that end with a brace at the margin.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shapes
from .lexer import TRIVIA, Token, tokenize

KEYWORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Atomic _Noreturn".split())
TYPES = frozenset("char const double enum extern float int long register short signed static struct union unsigned void volatile _Bool".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
FIELDS = ["path", "fact", "name", "owner", "start", "end", "line", "n", "flag", "text"]
SCHEMA = pa.schema([(k, pa.bool_() if k == "flag" else pa.string() if k in ("path", "fact", "name", "owner", "text") else pa.int64()) for k in FIELDS])


def directives(tokens: list[Token]) -> tuple[list[Token], list[list[Token]]]:
    """Tokens outside of directives, and the tokens of each directive."""
    code, found, fresh, i = [], [], True, 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "newline":
            fresh = True
        elif t.kind not in TRIVIA:
            if fresh and t.text == "#":
                one = []
                while i < len(tokens) and tokens[i].kind != "newline":
                    if tokens[i].kind not in TRIVIA:
                        one.append(tokens[i])
                    i += 1
                found.append(one)
                continue
            fresh = False
            code.append(t)
        i += 1
    return code, found


def pairs(code: list[Token]) -> dict[int, int] | None:
    """Where each bracket closes; None if they don't match."""
    stack, out = [], {}
    for i, t in enumerate(code):
        if t.kind == "punct" and t.text in OPEN:
            stack.append(i)
        elif t.kind == "punct" and t.text in CLOSE:
            if not stack or OPEN[code[stack[-1]].text] != t.text:
                return None
            out[stack.pop()] = i
    return None if stack else out


def first_arms(tokens: list[Token]) -> tuple[list[Token], list[list[Token]]]:
    """The tokens without the later arms of conditionals, and these arms."""
    kept, dropped, open_, fresh = [], [], [], True
    for i, t in enumerate(tokens):
        if t.kind == "newline":
            fresh = True
        elif t.kind not in TRIVIA:
            if fresh and t.text == "#":
                word = next((x.text for x in tokens[i + 1 :] if x.kind not in ("space", "tab")), "")
                if word in ("if", "ifdef", "ifndef"):
                    open_.append(False)
                elif word in ("else", "elif") and open_:
                    open_[-1] = True
                    dropped.append([])
                elif word == "endif" and open_:
                    open_.pop()
            fresh = False
        if any(open_) and dropped:
            dropped[-1].append(t)
        else:
            kept.append(t)
    return kept, [d for d in dropped if d]


def margin(t: Token, tokens: list[Token]) -> bool:
    """Whether a token begins its line."""
    k = bisect_left(tokens, t.start, key=lambda x: x.start)
    return k == 0 or tokens[k - 1].kind == "newline"


def split(code: list[Token], ends: dict[int, int], a: int, b: int, by: str = ",") -> list[tuple[int, int]]:
    """[a, b) cut at ``by`` outside of brackets."""
    out, start, i = [], a, a
    while i < b:
        if i in ends:
            i = ends[i]
        elif code[i].text == by:
            out.append((start, i))
            start = i + 1
        i += 1
    return [*out, (start, b)]


def declared(code: list[Token], ends: dict[int, int], a: int, b: int) -> str:
    """The name a declarator declares: the last identifier before its brackets or value."""
    name, i = "", a
    while i < b and code[i].text not in ("=", "["):
        if code[i].text == "(" and i + 1 < b and code[i + 1].text == "*":
            return next((t.text for t in code[i + 1 : ends[i]] if t.kind == "identifier" and t.text not in KEYWORDS), name)
        if code[i].text == "(":
            break
        if code[i].kind == "identifier" and code[i].text not in KEYWORDS:
            name = code[i].text
        i += 1
    return name


class Scan:
    def __init__(self, path: str, source: str, tokens: list[Token] | None = None, with_shapes: bool = True):
        self.path, self.rows, self.with_shapes = path, [], with_shapes
        self.bodies: list[tuple[str, int, int, bool]] = []  # name, head, brace, whether it returns a pointer
        self.heads: list[tuple[str, int, int]] = []  # fact, first token, name
        tokens = list(tokenize(source)) if tokens is None else tokens
        unknown = [t for t in tokens if t.kind == "unknown"]
        self.code, self.lines = directives(tokens)
        self.ends = pairs(self.code)
        self.safe = self.ends is not None and not unknown
        self.uses = Counter(t.text for t in tokens if t.kind == "identifier")
        self.notes = [(t.start, t.end) for t in tokens if t.kind.endswith("comment")] + [(d[0].start, d[-1].end) for d in self.lines]
        for d in self.lines:
            self.directive(d)
        if self.safe:
            self.top(0, len(self.code))
        else:
            self.add("unsafe", None, None, 0, 0, 1)
            self.recover(tokens, unknown)

    def recover(self, tokens: list[Token], unknown: list[Token]) -> None:
        """Reads what can be read, and says what can't."""
        for t in unknown:
            self.add("recovery", "unknown", None, t.start, t.end, t.line, text=t.text)
        kept, dropped = first_arms(tokens)
        for d in dropped if self.ends is None else ():
            self.add("recovery", "conditional", None, d[0].start, d[-1].end, d[0].line)
        self.code = [t for t in directives(tokens if self.ends is not None else kept)[0] if t.kind != "unknown"]
        self.ends = {}
        a = 0
        for b in [*(i + 1 for i, t in enumerate(self.code) if t.text == "}" and margin(t, tokens)), len(self.code)]:
            part = pairs(self.code[a:b])
            if part is None:
                self.add("recovery", "syntax", None, self.code[a].start, self.code[b - 1].end, self.code[a].line)
            else:
                self.ends |= {a + x: a + y for x, y in part.items()}
                self.top(a, b)
            a = b

    def add(self, fact, name, owner, start, end, line, n=None, flag=None, text=None) -> None:
        self.rows.append((self.path, fact, name, owner, start, end, line, n, flag, text))

    def of(self, a: int, b: int) -> str:
        return " ".join(t.text for t in self.code[a:b])

    def directive(self, d: list[Token]) -> None:
        if len(d) > 1:
            name = d[2].text if len(d) > 2 else None
            called = len(d) > 3 and d[3].text == "(" and d[3].start == d[2].end
            self.add("directive", d[1].text, None, d[0].start, d[-1].end, d[0].line, text=" ".join(t.text for t in d))
            if d[1].text == "define" and name:
                self.add("macro", name, None, d[2].start, d[-1].end, d[0].line, flag=called, text=" ".join(t.text for t in d[3:]))

    def top(self, a: int, b: int) -> None:
        code, i = self.code, a
        while i < b:
            start = i
            while i < b and code[i].text not in (";", "{", "="):
                i = self.ends.get(i, i) + 1
            head = code[start:i]
            if i < b and code[i].text == "{":
                close = self.ends[i]
                if head and head[-1].text == ")" and not any(t.text in ("struct", "union", "enum") and k == len(head) - 1 for k, t in enumerate(head)):
                    self.function(start, i, close)
                    i = close + 1
                    continue
                self.tag(start, i, close)
                i = close + 1
                while i < b and code[i].text != ";":
                    i = self.ends.get(i, i) + 1
                i += 1
                continue
            if i < b and code[i].text == "=":
                self.array(start, i, None)
                while i < b and code[i].text != ";":
                    i = self.ends.get(i, i) + 1
            elif head and head[-1].text == ")" and head[0].text != "typedef":
                self.function(start, i, None)
            else:
                self.array(start, i, None)
            i += 1

    def tag(self, start: int, brace: int, close: int) -> None:
        words = [t.text for t in self.code[start:brace]]
        kind = next((w for w in words if w in ("struct", "union", "enum")), None)
        if kind is None:
            return
        k = start + words.index(kind) + 1
        if k < brace:
            self.add("tag", self.code[k].text, kind, self.code[k].start, self.code[k].end, self.code[k].line)
        if kind == "enum":
            for a, b in split(self.code, self.ends, brace + 1, close):
                if a < b:
                    t = self.code[a]
                    self.add("enum_constant", t.text, str(self.code[brace].start), t.start, t.end, t.line, text=self.of(a + 2, b) if a + 1 < b else None)

    def array(self, a: int, b: int, owner: str | None) -> None:
        for i in range(a, b):
            if self.code[i].text == "[" and i > a and self.code[i - 1].kind == "identifier":
                t = self.code[i - 1]
                self.add("array", t.text, owner, t.start, t.end, t.line, text=self.of(i + 1, self.ends[i]))

    def function(self, start: int, stop: int, close: int | None) -> None:
        code, k = self.code, start
        while k < stop and not (code[k].text == "(" and k > start and code[k - 1].kind == "identifier" and code[k - 1].text not in KEYWORDS and code[k - 1].text != "__attribute__"):
            k += 1
        if k >= stop or k - 1 == start:
            return
        name, before = code[k - 1].text, [t.text for t in code[start : k - 1]]
        given = [(a, b) for a, b in split(code, self.ends, k + 1, self.ends[k]) if a < b]
        if len(given) == 1 and given[0][1] - given[0][0] == 1 and code[given[0][0]].text == "void":
            given = []
        names = [declared(code, self.ends, a, b) for a, b in given]
        fact, end = ("definition", code[close].end) if close is not None else ("prototype", code[stop - 1].end)
        body = max(0, code[close].line - code[stop].line - 1) if close is not None else None
        self.add(fact, name, "static" if "static" in before else None, code[start].start, end, code[k - 1].line, n=len(given), flag=bool(before) and before[-1] == "*", text=None if body is None else str(body))
        self.heads.append((fact, start, k - 1))
        for n in names:
            self.add("parameter", n, name, code[k].start, code[self.ends[k]].end, code[k].line)
        if close is not None:
            self.bodies.append((name, start, stop, bool(before) and before[-1] == "*"))
            for shape, own, a, b, text in () if not self.with_shapes else shapes.shapes(shapes.Statements(code, self.ends), stop, self.notes, self.uses):
                self.add(shape, own, name, code[a].start, code[b - 1].end, code[a].line, text=text)
            if close == stop + 1:
                self.add("empty", name, name, code[stop].start, code[close].end, code[stop].line)
            self.initial = True
            self.block(stop + 1, close, name)

    def declaration(self, a: int, b: int) -> bool:
        """Whether the statement [a, b) declares: a type word, or a name followed by a name, stars between them allowed."""
        code = self.code
        if code[a].text in TYPES:
            return True
        if code[a].kind != "identifier" or code[a].text in KEYWORDS:
            return False
        k = a + 1
        while k < b and code[k].text == "*":
            k += 1
        return k < b and code[k].kind == "identifier" and code[k].text not in KEYWORDS and (k == b - 1 or code[k + 1].text in ("=", ",", "[", ";"))

    def block(self, a: int, b: int, owner: str) -> None:
        code, i = self.code, a
        scope = (code[a - 1].start, code[b].end)
        while i < b:
            t = code[i]
            if t.text == "{":
                self.initial = False
                self.block(i + 1, self.ends[i], owner)
                i = self.ends[i] + 1
                continue
            end = i
            while end < b and code[end].text not in (";", "{"):
                end = self.ends.get(end, end) + 1
            if t.kind == "identifier" and self.declaration(i, end) and (end >= b or code[end].text == ";"):
                for k, (x, y) in enumerate(split(code, self.ends, i, end)):
                    name = declared(code, self.ends, x, y)
                    if name:
                        self.add("local", name, owner, scope[0], scope[1], code[x].line, n=k, flag=self.initial)
                self.array(i, end, owner)
                self.calls(i, end, owner)
                i = end + 1
                continue
            self.initial = False
            if t.text in ("while", "for") and i + 1 < b and code[i + 1].text == "(":
                close = self.ends[i + 1]
                inside = self.of(i + 2, close)
                forever = inside in ("1", "true") if t.text == "while" else bool(re.fullmatch(r";\s*;.*", inside))
                stop = self.ends[close + 1] if close + 1 in self.ends and code[close + 1].text == "{" else end
                self.add("loop", t.text, owner, t.start, code[min(stop, b - 1)].end, t.line, n=int(forever), flag=self.leaves(close + 1, stop))
                self.calls(i + 1, close + 1, owner)
                i = close + 1
                continue
            if t.text == ";" and (i == a or code[i - 1].text in (";", "{", "}")):
                self.add("empty_statement", None, owner, t.start, t.end, t.line)
            self.calls(i, min(end, b), owner)
            i = end if end < b and code[end].text == "{" else end + 1

    def leaves(self, a: int, b: int) -> bool:
        """Whether a loop's body leaves it: return or goto anywhere, break that belongs to no inner loop or switch."""
        i, code = a, self.code
        while i < b:
            w = code[i].text
            if w in ("return", "goto", "exit", "abort"):
                return True
            if w == "break":
                return True
            if w in ("while", "for", "switch") and i + 1 < b and code[i + 1].text == "(":
                close = self.ends[i + 1]
                end = self.ends.get(close + 1, close)
                if any(t.text in ("return", "goto", "exit", "abort") for t in code[close:end]):
                    return True
                i = end
            i += 1
        return False

    def calls(self, a: int, b: int, owner: str) -> None:
        for i in range(a, b - 1):
            t = self.code[i]
            if t.kind == "identifier" and t.text not in KEYWORDS and self.code[i + 1].text == "(" and (i == a or self.code[i - 1].text not in ("->", ".")):
                self.add("call", t.text, owner, t.start, t.end, t.line)
            if t.kind == "identifier" and t.text not in KEYWORDS:
                self.add("reference", t.text, owner, t.start, t.end, t.line)
        if b > a and self.code[b - 1].kind == "identifier" and self.code[b - 1].text not in KEYWORDS:
            t = self.code[b - 1]
            self.add("reference", t.text, owner, t.start, t.end, t.line)


#: Rows handed on together.
MOST = 1 << 16


def columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FIELDS), SCHEMA, strict=True)], schema=SCHEMA)


def rows_of(path: str, source: str) -> list[tuple]:
    """The rows of one file; one that is nested too deep for the scan is unsafe, and no harm to the others."""
    try:
        return Scan(path, source).rows
    except RecursionError:
        whole = (0, len(source.encode()), 1)
        return [(path, "unsafe", None, None, 0, 0, 1, None, None, None), (path, "recovery", "too deep", None, *whole, None, None, None)]


def facts(sources: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows += rows_of(path.as_py(), content.as_py() or "")
                if len(rows) > MOST:
                    yield columns(rows)
                    rows = []
            yield columns(rows)

    return sources.select("path", "content").mapInArrow(run, "path string, fact string, name string, owner string, start long, `end` long, line long, n long, flag boolean, text string")


def view(rows: DataFrame, fact: str) -> DataFrame:
    return rows.where(F.col("fact") == fact)


def functions(rows: DataFrame) -> DataFrame:
    """(path, kind, name, start, end, line, is_static, returns_pointer, parameter_count, body_lines)"""
    own = rows.where(F.col("fact").isin("definition", "prototype"))
    return own.select("path", F.col("fact").alias("kind"), "name", "start", "end", "line", F.coalesce(F.col("owner") == "static", F.lit(False)).alias("is_static"), F.col("flag").alias("returns_pointer"), F.col("n").alias("parameter_count"), F.col("text").cast("long").alias("body_lines"))


def locals_(rows: DataFrame) -> DataFrame:
    """(path, function, name, line, initial, scope_start, scope_end)"""
    return view(rows, "local").select("path", F.col("owner").alias("function"), "name", "line", F.col("flag").alias("initial"), F.col("start").alias("scope_start"), F.col("end").alias("scope_end"))
