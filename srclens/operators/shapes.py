"""Statements of C functions as trees over tokens, and the shapes in them that rules and rewrites look for.

``Statements`` reads a function's body from the tokens between its braces; the
functions below each find one shape.  All work on indices of significant tokens
outside of directives, and give byte ranges.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from .lexer import Token

#: Operators that assign, and all that may stand between two operands.
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
BINARY = ASSIGN | frozenset("+ - * / % & | ^ << >> < > <= >= == != && ||".split())
#: Words that begin or belong to a type.
TYPE_WORDS = frozenset("char const double enum extern float int long register restrict short signed static struct union unsigned void volatile _Bool".split())
WORDS = TYPE_WORDS | frozenset("auto break case continue default do else for goto if inline return sizeof switch typedef while".split())


@dataclass(slots=True, eq=False)
class Statement:
    """kind, tokens [a, b); head: the tokens between a control's parentheses; body, other: what it controls; parts: a block's statements."""

    kind: str
    a: int
    b: int
    head: tuple[int, int] | None = None
    body: Statement | None = None
    other: Statement | None = None
    parts: list[Statement] = field(default_factory=list)

    def inner(self) -> Iterator[Statement]:
        for s in (self.body, self.other, *self.parts):
            if s is not None:
                yield s

    def walk(self) -> Iterator[Statement]:
        todo = [self]
        while todo:
            s = todo.pop()
            yield s
            todo.extend(reversed(list(s.inner())))


class Statements:
    def __init__(self, code: list[Token], ends: dict[int, int]):
        self.code, self.ends = code, ends
        self.opens = {b: a for a, b in ends.items()}

    def word(self, i: int) -> str:
        return self.code[i].text if i < len(self.code) else ""

    def block(self, brace: int) -> Statement:
        out = Statement("block", brace, self.ends[brace] + 1)
        i = brace + 1
        while i < out.b - 1:
            s = self.statement(i, out.b - 1)
            out.parts.append(s)
            i = s.b
        return out

    def statement(self, i: int, stop: int) -> Statement:
        word = self.word(i)
        if word == "{":
            return self.block(i)
        if word in ("if", "while", "for", "switch") and self.word(i + 1) == "(":
            close = self.ends[i + 1]
            out = Statement(word, i, close + 1, (i + 2, close))
            if close + 1 < stop:
                out.body = self.statement(close + 1, stop)
                out.b = out.body.b
            if word == "if" and out.b < stop and self.word(out.b) == "else" and out.b + 1 < stop:
                out.other = self.statement(out.b + 1, stop)
                out.b = out.other.b
            return out
        if word == "do" and i + 1 < stop:
            body = self.statement(i + 1, stop)
            b = body.b
            head = None
            if self.word(b) == "while" and self.word(b + 1) == "(":
                head, b = (b + 2, self.ends[b + 1]), self.ends[b + 1] + 1
            return Statement("do", i, min(stop, b + 1), head, body)
        if word in ("case", "default"):
            j = i
            while j < stop and self.word(j) != ":":
                j = self.ends.get(j, j) + 1
            return Statement("label", i, min(stop, j + 1))
        if self.code[i].kind == "identifier" and word not in WORDS and self.word(i + 1) == ":":
            return Statement("label", i, i + 2)
        j = i
        while j < stop and self.word(j) != ";":
            j = self.ends.get(j, j) + 1
        j = min(j, stop)
        kind = "empty" if j == i else "return" if word == "return" else "jump" if word in ("break", "continue", "goto") else "declaration" if self.declares(i, j) else "expression"
        return Statement(kind, i, min(stop, j + 1))

    def declares(self, a: int, b: int) -> bool:
        """A type word first, or a name followed by a name, stars between them allowed."""
        if self.word(a) in TYPE_WORDS:
            return True
        if self.code[a].kind != "identifier" or self.word(a) in WORDS:
            return False
        k = a + 1
        while k < b and self.word(k) == "*":
            k += 1
        return k < b and self.code[k].kind == "identifier" and self.word(k) not in WORDS and (k == b - 1 or self.word(k + 1) in ("=", ",", "["))

    def split(self, a: int, b: int, by: str = ",") -> list[tuple[int, int]]:
        """[a, b) cut at ``by`` outside of brackets."""
        out, start, i = [], a, a
        while i < b:
            if i in self.ends:
                i = self.ends[i]
            elif self.word(i) == by:
                out.append((start, i))
                start = i + 1
            i += 1
        return [*out, (start, b)]

    def at_depth(self, a: int, b: int) -> Iterator[int]:
        """Indices of [a, b) outside of brackets; a bracket's opening one counts."""
        i = a
        while i < b:
            yield i
            i = self.ends.get(i, i) + 1

    def end(self, s: Statement) -> int:
        """Index of a simple statement's ';', or its end."""
        return s.b - 1 if self.word(s.b - 1) == ";" else s.b

    def declarators(self, s: Statement) -> tuple[int, list[tuple[int, int]]]:
        """Where the type of a declaration ends, and its declarators with their values."""
        parts = self.split(s.a, self.end(s))
        k = s.a
        while k < parts[0][1] and self.word(k) not in ("*", "(", "=", "["):
            k += 1
        if k == parts[0][1] or self.word(k) in ("=", "["):
            k -= 1  # a plain name
        return k, [(k, parts[0][1]), *parts[1:]]

    def name(self, a: int, b: int) -> str:
        """What a declarator declares."""
        for i in range(a, b):
            if self.word(i) == "=":
                break
            if self.code[i].kind == "identifier" and self.word(i) not in WORDS:
                return self.word(i)
        return ""

    def value(self, a: int, b: int) -> int | None:
        """Index of the '=' of a declarator or assignment outside of brackets."""
        return next((i for i in self.at_depth(a, b) if self.word(i) == "="), None)

    def pure(self, a: int, b: int) -> bool:
        """No call, assignment or update in [a, b)."""
        words = [self.word(i) for i in range(a, b)]
        called = any(self.word(i + 1) == "(" and self.code[i].kind == "identifier" and self.word(i) != "sizeof" for i in range(a, b - 1))
        return not called and not any(w in ASSIGN or w in ("++", "--") for w in words)

    def is_cast(self, close: int) -> bool:
        """Whether the parenthesis that closes here holds a type alone."""
        a = self.opens.get(close)
        inside = [self.word(i) for i in range(a + 1, close)] if a is not None else []
        return bool(inside) and (inside[0] in TYPE_WORDS or (inside[-1] == "*" and all(w == "*" or re.match(r"[A-Za-z_]", w) for w in inside)))

    def binary(self, i: int) -> bool:
        """Whether token i stands between two operands, by the token before it."""
        if self.word(i) not in BINARY or i == 0 or self.code[i].kind != "punct":
            return False
        p = self.code[i - 1]
        if p.text == ")":
            return not self.is_cast(i - 1)
        return p.text == "]" or p.kind in ("number", "string", "char") or (p.kind == "identifier" and p.text not in WORDS) or (p.text in ("++", "--") and i > 1 and self.code[i - 2].kind == "identifier")


def one_return(s: Statement | None) -> Statement | None:
    """The only statement of an arm, if it is a return."""
    if s is not None and s.kind == "block" and len(s.parts) == 1:
        s = s.parts[0]
    return s if s is not None and s.kind == "return" else None


def stars(t: Statements, body: Statement) -> set[int]:
    """Stars that belong to declarators or casts in a body."""
    out: set[int] = set()
    for s in body.walk():
        if s.kind == "declaration":
            _, parts = t.declarators(s)
            for a, b in parts:
                stop = t.value(a, b)
                out |= {i for i in range(a, b if stop is None else stop) if t.word(i) == "*"}
    for i in range(body.a, body.b):
        if t.word(i) == "(" and i in t.ends and t.is_cast(t.ends[i]):
            out |= {k for k in range(i, t.ends[i]) if t.word(k) == "*"}
    return out


def binary_operators(t: Statements, body: Statement) -> list[int]:
    declared = stars(t, body)
    return [i for i in range(body.a, body.b) if i not in declared and t.binary(i)]


def initial(t: Statements, body: Statement) -> list[Statement]:
    """The declarations that a block begins with."""
    out = []
    for s in body.parts:
        if s.kind != "declaration":
            break
        out.append(s)
    return out


def continues(s: Statement, t: Statements) -> bool:
    """Whether a loop's body holds a continue of its own."""
    todo = [s]
    while todo:
        x = todo.pop()
        if x.kind == "jump" and t.word(x.a) == "continue":
            return True
        if x.kind not in ("while", "for", "do"):
            todo.extend(x.inner())
    return False


def in_blocks(body: Statement) -> Iterator[tuple[Statement, int, Statement]]:
    """(block, place, statement) of every statement that stands directly in a block."""
    for s in body.walk():
        if s.kind == "block":
            for k, part in enumerate(s.parts):
                yield s, k, part


def ternary(t: Statements, s: Statement) -> tuple[int, int, int, int] | None:
    """(first, '?', ':', end) of a statement that assigns or returns one conditional value, with no other in it; first is where the condition begins."""
    if s.kind not in ("expression", "return"):
        return None
    a, b = s.a, t.end(s)
    if s.kind == "return":
        a += 1
        if t.word(a) == "(" and t.ends.get(a) == b - 1:
            a, b = a + 1, b - 1
    else:
        at = next((i for i in t.at_depth(a, b) if t.word(i) in ASSIGN), None)
        if at is None or not t.pure(a, at):
            return None
        a = at + 1
    marks = [i for i in range(a, b) if t.word(i) in ("?", ":")]
    if [t.word(i) for i in marks] != ["?", ":"] or not set(marks) <= set(t.at_depth(a, b)) or any(t.word(i) in ASSIGN | {","} for i in t.at_depth(a, b)):
        return None
    return a, marks[0], marks[1], b


def chained(t: Statements, s: Statement) -> tuple[int, int] | None:
    """The two assignment operators of 'a = b = v', its targets without side effects."""
    if s.kind != "expression":
        return None
    at = [i for i in t.at_depth(s.a, t.end(s)) if t.word(i) in ASSIGN]
    if len(at) != 2 or t.word(at[1]) != "=" or any(t.word(i) in (",", "?") for i in t.at_depth(s.a, t.end(s))) or not t.pure(s.a, at[0]) or not t.pure(at[0] + 1, at[1]):
        return None
    return at[0], at[1]


def splittable(t: Statements, s: Statement) -> bool:
    """'T x = v' that may become a declaration and an assignment."""
    if s.kind != "declaration":
        return False
    words = {t.word(i) for i in t.at_depth(s.a, t.end(s))}
    _, parts = t.declarators(s)
    at = t.value(*parts[0])
    return len(parts) == 1 and at is not None and not words & {"const", "static", "extern", "register", "["} and t.word(at + 1) != "{"


def shared_type(t: Statements, s: Statement) -> bool:
    """A declaration of two names at least, of a type that is written out."""
    if s.kind != "declaration":
        return False
    k, parts = t.declarators(s)
    return len(parts) > 1 and k > s.a and not any(t.word(i) in ("struct", "union", "enum", "{") for i in range(s.a, s.b))


def inert_local(t: Statements, s: Statement, uses: Counter[str]) -> str | None:
    """The one name of a declaration that nothing else mentions and whose value does nothing."""
    if s.kind != "declaration":
        return None
    _, parts = t.declarators(s)
    name, at = t.name(*parts[0]), t.value(*parts[0])
    if len(parts) != 1 or not name or uses[name] != 1 or t.word(s.a) in ("static", "extern"):
        return None
    return name if at is None or t.pure(at + 1, parts[0][1]) else None


def shapes(t: Statements, brace: int, notes: list[tuple[int, int]], uses: Counter[str]) -> Iterator[tuple[str, str | None, int, int, str | None]]:
    """(fact, name, first token, token behind the last, text) of a function's body.  notes: byte ranges of comments and directives, which block rewrites."""
    body = t.block(brace)
    code = t.code

    def clean(a: int, b: int) -> bool:
        return not any(x < code[b - 1].end and y > code[a].start for x, y in notes)

    def text(a: int, b: int) -> str:
        return " ".join(t.word(i) for i in range(a, b))

    first = initial(t, body)
    if first:
        yield "initial_block", None, first[0].a, first[-1].b, str(len(first))
    for i in binary_operators(t, body):
        yield "binary_operator", t.word(i), i, i + 1, None
        if t.word(i) == "==" and "NULL" in (t.word(i + 1), t.word(i - 1)):
            yield "null_check", t.word(i - 1) if t.word(i + 1) == "NULL" else t.word(i + 1), i - 1, i + 2, None
    for i in sorted(stars(t, body)):
        yield "pointer_star", None, i, i + 1, None
    for s in body.walk():
        if s.kind == "block":
            yield "compound", None, s.a, s.b, str(len(s.parts))
        if s.kind in ("if", "while", "for", "do"):
            for arm in (s.body, s.other):
                if arm is None:
                    continue
                if arm.kind == "block" and len(arm.parts) == 1 and arm.parts[0].kind in ("expression", "return", "jump") and clean(arm.a, arm.b):
                    yield "single_body", s.kind, arm.a, arm.b, None
                if arm.kind != "block" and arm.a > 0 and code[arm.a].line == code[arm.a - 1].line and not (arm is s.other and arm.kind == "if"):
                    yield "inline_body", s.kind, arm.a, arm.b, None
        if s.kind == "return":
            yield "return", None, s.a, t.end(s), text(s.a + 1, t.end(s))
        if s.kind == "if" and one_return(s.body) and one_return(s.other) and clean(s.a, s.b):
            yield "redundant_else", None, s.body.b, s.b, None
    for block, k, s in in_blocks(body):
        if (name := inert_local(t, s, uses)) is not None:
            yield "inert_local", name, s.a, s.b, None
        if splittable(t, s) and clean(s.a, s.b):
            yield "declaration_split", t.name(*t.declarators(s)[1][0]), s.a, s.b, None
        if shared_type(t, s) and clean(s.a, s.b):
            yield "shared_declaration", None, s.a, s.b, str(len(t.declarators(s)[1]))
        if ternary(t, s) and clean(s.a, s.b):
            yield "ternary", s.kind, s.a, s.b, None
        if chained(t, s) and clean(s.a, s.b):
            yield "chained_assignment", None, s.a, s.b, text(s.a, s.b)
        if s.kind == "for" and s.body is not None and not t.declares(s.head[0], s.head[1]) and clean(s.a, s.b) and len(t.split(*s.head, ";")) == 3 and not (continues(s.body, t) and t.split(*s.head, ";")[2][0] < s.head[1]):
            yield "for_loop", None, s.a, s.b, text(*s.head)
        if k and code[s.a].line == code[block.parts[k - 1].b - 1].line and block.parts[k - 1].kind != "label" and clean(block.parts[k - 1].a, s.b):
            yield "crowded", None, s.a, s.b, None
