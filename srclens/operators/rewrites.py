"""Rewrites of C sources by the shapes of their statements.

Each takes a ``View`` of one source and gives edits (start, end, text) in bytes;
``apply_edits`` makes them all or none.  Layout rewrites move white space alone;
the others are proved by the schedule that runs them (``transforms.fix``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

from . import shapes
from .facts import Scan
from .lexer import TRIVIA, tokenize
from .shapes import ASSIGN, Statement, Statements

Edit = tuple[int, int, str]
TAB, COLUMNS, BUDGET = 4, 80, 25


def conflicts(edits: Iterable[Edit]) -> bool:
    """Whether two edits overlap, or insert at one place."""
    done = sorted(set(edits))
    return any(b[0] < a[1] or (b[0] == a[0] and b[1] == a[1]) for a, b in pairwise(done))


def apply_edits(source: str, edits: Iterable[Edit]) -> str:
    """The source with all edits made, repeated ones once; ValueError if any two conflict or one leaves the source."""
    data, done = source.encode(), sorted(set(edits))
    if conflicts(done) or any(not 0 <= a <= b <= len(data) for a, b, _ in done):
        raise ValueError("edits overlap or leave the source")
    for a, b, text in reversed(done):
        data = data[:a] + text.encode() + data[b:]
    return data.decode()


def width(text: str) -> int:
    return len(text.expandtabs(TAB))


class View:
    """A source with its tokens, the brackets among them, and the statements of its functions."""

    def __init__(self, source: str):
        self.source, self.data = source, source.encode()
        self.tokens = list(tokenize(source))
        self.scan = Scan("", source, self.tokens, with_shapes=False)
        self.code, self.ends = self.scan.code, self.scan.ends
        self.t = Statements(self.code, self.ends)
        self.bodies = [(name, head, brace, self.t.block(brace)) for name, head, brace, _ in self.scan.bodies] if self.scan.safe else []
        self.notes, self.uses = sorted(self.scan.notes), self.scan.uses
        self.breaks = [0, *(m.end() for m in re.finditer(rb"\n", self.data))]

    def clean(self, a: int, b: int) -> bool:
        """No comment or directive between bytes."""
        return not any(x < b and y > a for x, y in self.notes)

    def clean_tokens(self, a: int, b: int) -> bool:
        return self.clean(self.code[a].start, self.code[b - 1].end)

    def line_start(self, at: int) -> int:
        return self.data.rfind(b"\n", 0, at) + 1

    def indent(self, at: int) -> str:
        """The white space that the line of a byte begins with."""
        line = self.data[self.line_start(at) :]
        return line[: len(line) - len(line.lstrip(b" \t"))].decode()

    def first_on_line(self, at: int) -> bool:
        return not self.data[self.line_start(at) : at].strip()

    def text(self, a: int, b: int) -> str:
        """The source of tokens [a, b)."""
        return self.data[self.code[a].start : self.code[b - 1].end].decode() if b > a else ""

    def gap(self, i: int) -> tuple[int, int]:
        """The bytes between token i - 1 and token i."""
        return self.code[i - 1].end, self.code[i].start

    def blank(self, i: int) -> bool:
        """Whether only white space lies before token i, and no line break is escaped."""
        a, b = self.gap(i)
        return not self.data[a:b].strip()

    def statements(self) -> Iterator[Statement]:
        for *_, body in self.bodies:
            yield from body.walk()

    def in_blocks(self) -> Iterator[tuple[Statement, int, Statement]]:
        for *_, body in self.bodies:
            yield from shapes.in_blocks(body)

    def lines_of(self, body: Statement) -> int:
        return max(0, self.code[body.b - 1].line - self.code[body.a].line - 1)


@lru_cache(maxsize=4)
def view(source: str) -> View:
    """The view of a source; the last few are kept, since most rewrites change nothing."""
    return View(source)


def break_before(v: View, i: int, indent: str) -> Edit | None:
    """A line break and this indent before token i, if only white space on one line lies there."""
    if v.blank(i) and v.code[i].line == v.code[i - 1].line:
        return (*v.gap(i), "\n" + indent)
    return None


def else_newline(v: View) -> list[Edit]:
    return [e for s in v.statements() if s.other is not None for e in [break_before(v, s.body.b, v.indent(v.code[s.a].start))] if e]


def brace_newline(v: View) -> list[Edit]:
    """The brace of a function or control on a line of its own."""
    out = [break_before(v, brace, "") for _, _, brace, _ in v.bodies]
    for s in v.statements():
        for arm in (s.body, s.other):
            if arm is not None and arm.kind == "block":
                out.append(break_before(v, arm.a, v.indent(v.code[s.a].start)))
    return [e for e in out if e]


def body_newline(v: View) -> list[Edit]:
    """What a control governs without braces goes to the next line, one tab further in."""
    out = []
    for s in v.statements():
        for arm in (s.body, s.other):
            if arm is not None and arm.kind not in ("block", "empty") and not (arm is s.other and arm.kind == "if"):
                out.append(break_before(v, arm.a, v.indent(v.code[s.a].start) + "\t"))
    return [e for e in out if e]


def block_newline(v: View) -> list[Edit]:
    """A block's content and its closing brace on lines of their own."""
    out = []
    for s in v.statements():
        if s.kind == "block" and s.parts:
            indent = v.indent(v.code[s.a].start)
            out += [break_before(v, s.a + 1, indent + "\t"), break_before(v, s.b - 1, indent)]
    return [e for e in out if e]


def operator_spacing(v: View) -> list[Edit]:
    """One blank on each side of an operator between operands; line breaks stay."""
    out = set()
    for *_, body in v.bodies:
        for i in shapes.binary_operators(v.t, body):
            for k in (i, i + 1):
                a, b = v.gap(k)
                if v.code[k].line == v.code[k - 1].line and v.blank(k) and v.data[a:b] != b" ":
                    out.add((a, b, " "))
    return sorted(out)


def crowded(v: View) -> list[Edit]:
    out = []
    for block, k, s in v.in_blocks():
        if k and block.parts[k - 1].kind != "label" and v.clean_tokens(block.parts[k - 1].a, s.b):
            out.append(break_before(v, s.a, v.indent(v.code[s.a].start)))
    return [e for e in out if e]


def single_braces(v: View) -> list[Edit]:
    """Braces around one simple statement go.  A block inside another that goes waits for the next pass."""
    out, last = [], -1
    for s in v.statements():
        for arm in (s.body, s.other):
            if s.kind in ("if", "while", "for") and arm is not None and arm.kind == "block" and arm.a > last and len(arm.parts) == 1 and arm.parts[0].kind in ("expression", "return", "jump") and v.clean(v.code[arm.a - 1].end, v.code[arm.b - 1].end):
                one, indent = arm.parts[0], v.indent(v.code[s.a].start)
                out.append((v.code[arm.a - 1].end, v.code[arm.b - 1].end, f"\n{indent}\t{v.text(one.a, one.b)}"))
                last = arm.b
    return out


def redundant_else(v: View) -> list[Edit]:
    out = []
    for _, _, s in v.in_blocks():
        if s.kind == "if" and shapes.one_return(s.body) and (other := shapes.one_return(s.other)) and v.clean_tokens(s.a, s.b):
            out.append((v.code[s.body.b - 1].end, v.code[s.b - 1].end, f"\n{v.indent(v.code[s.a].start)}{v.text(other.a, other.b)}"))
    return out


def budgeted(v: View, found: Callable[[Statement], Iterator[tuple[Edit, int]]]) -> list[Edit]:
    """The edits of each function whose added lines still fit its budget, in order; one that does not is passed over and costs nothing."""
    out = []
    for *_, body in v.bodies:
        spent = v.lines_of(body)
        for edit, more in found(body):
            if spent + more <= BUDGET:
                spent += more
                out.append(edit)
    return out


def for_loops(v: View) -> list[Edit]:
    """for becomes while; of nested ones the outermost first."""

    def found(body: Statement) -> Iterator[tuple[Edit, int]]:
        last = -1
        for _, _, s in shapes.in_blocks(body):
            if s.kind != "for" or s.body is None or s.a < last or not v.clean_tokens(s.a, s.b) or v.t.declares(*s.head):
                continue
            parts = v.t.split(*s.head, ";")
            if len(parts) != 3 or (parts[2][0] < parts[2][1] and shapes.continues(s.body, v.t)):
                continue
            indent = v.indent(v.code[s.a].start)
            first, step = ([v.text(a, b) + ";" for a, b in v.t.split(*parts[k]) if a < b] for k in (0, 2))
            inner = [] if s.body.kind == "empty" else [v.text(x.a, x.b) for x in s.body.parts] if s.body.kind == "block" else [v.text(s.body.a, s.body.b)]
            lines = [*(indent + x for x in first), f"{indent}while ({v.text(*parts[1]) or '1'})"]
            rows = [*inner, *step]
            if len(rows) > 1 or s.body.kind == "block":
                lines += [indent + "{", *(f"{indent}\t{x}" for x in rows), indent + "}"]
            else:
                lines += [f"{indent}\t{x}" for x in rows or [";"]]
            text = "\n".join(lines).lstrip()
            yield (v.code[s.a].start, v.code[s.b - 1].end, text), text.count("\n") - (v.code[s.b - 1].line - v.code[s.a].line)
            last = s.b

    return budgeted(v, found)


def ternaries(v: View) -> list[Edit]:
    """A conditional value that is assigned or returned becomes if and else, or if and return."""

    def found(body: Statement) -> Iterator[tuple[Edit, int]]:
        for _, _, s in shapes.in_blocks(body):
            marks = shapes.ternary(v.t, s)
            if marks is None or not v.clean_tokens(s.a, s.b):
                continue
            a, ask, colon, b = marks
            indent, left = v.indent(v.code[s.a].start), v.text(s.a, a)
            cond, yes, no = v.text(a, ask), v.text(ask + 1, colon), v.text(colon + 1, b)
            cond = cond[1:-1] if v.t.word(a) == "(" and v.ends.get(a) == ask - 1 else cond
            if s.kind == "return":
                lines = [f"if ({cond})", f"\treturn ({yes});", f"return ({no});"]
            else:
                lines = [f"if ({cond})", f"\t{left} {yes};", "else", f"\t{left} {no};"]
            text = f"\n{indent}".join(lines)
            yield (v.code[s.a].start, v.code[s.b - 1].end, text), len(lines) - 1

    return budgeted(v, found)


def chained(v: View) -> list[Edit]:
    def found(body: Statement) -> Iterator[tuple[Edit, int]]:
        for _, _, s in shapes.in_blocks(body):
            at = shapes.chained(v.t, s)
            if at is None or not v.clean_tokens(s.a, s.b):
                continue
            first, target = v.text(at[0] + 1, v.t.end(s)), v.text(at[0] + 1, at[1])
            text = f"{first};\n{v.indent(v.code[s.a].start)}{v.text(s.a, at[0] + 1)} {target};"
            yield (v.code[s.a].start, v.code[s.b - 1].end, text), 1

    return budgeted(v, found)


def one_declaration(v: View) -> list[Edit]:
    def found(body: Statement) -> Iterator[tuple[Edit, int]]:
        for _, _, s in shapes.in_blocks(body):
            if shapes.shared_type(v.t, s) and v.clean_tokens(s.a, s.b):
                k, parts = v.t.declarators(s)
                kind = v.data[v.code[s.a].start : v.code[k].start].decode()
                text = f"\n{v.indent(v.code[s.a].start)}".join(f"{kind}{v.text(a, b)};" for a, b in parts)
                yield (v.code[s.a].start, v.code[s.b - 1].end, text), len(parts) - 1

    return budgeted(v, found)


def split_declarations(v: View) -> list[Edit]:
    """Values of a function's first declarations become assignments behind them, all of those behind the first or none."""

    def found(body: Statement) -> Iterator[tuple[Edit, int]]:
        first = shapes.initial(v.t, body)
        if not first or not v.clean_tokens(first[0].a, first[-1].b):
            return
        given = [s for s in first if any(v.t.value(a, b) is not None for a, b in v.t.declarators(s)[1])]
        while given and not all(shapes.splittable(v.t, s) for s in given):
            given.pop(0)
        if not given:
            return
        edits, rest = [], []
        for s in given:
            _, parts = v.t.declarators(s)
            at = v.t.value(*parts[0])
            edits.append((v.code[at - 1].end, v.code[v.t.end(s) - 1].end, ""))
            rest.append(f"\n{v.indent(v.code[s.a].start)}{v.t.name(*parts[0])} = {v.text(at + 1, parts[0][1])};")
        # one edit from the first to the last of the block, so that the budget takes all or none
        a, b = v.code[first[0].a].start, v.code[first[-1].b - 1].end
        text = apply_edits(v.data[a:b].decode(), [(x - a, y - a, z) for x, y, z in edits])
        yield (a, b, f"{text}\n{''.join(rest)}"), len(rest) + 1

    return budgeted(v, found)


def stop_after(columns: int) -> int:
    """The next tab stop behind a text of so many columns."""
    return (columns // TAB + 1) * TAB


def tabs_to(columns: int, target: int) -> str:
    return "\t" * (-(-(target - columns) // TAB))


def function_layout(v: View) -> list[Edit]:
    """One tab before a definition's name; a common stop for the names of a file's prototypes."""
    out, protos = [], []
    for fact, start, name in v.scan.heads:
        k = name
        while k > start and v.code[k - 1].text == "*":
            k -= 1
        if k == start or v.code[k - 1].line != v.code[k].line or not v.first_on_line(v.code[start].start) or v.code[start].line != v.code[k].line:
            continue
        a, b = v.gap(k)
        stars_end = v.code[name].start
        joined = "*" * (name - k)
        if not v.clean(a, stars_end):
            continue
        if fact == "definition":
            out.append((a, stars_end, "\t" + joined))
        else:
            protos.append((width(v.data[v.line_start(a) : a].decode()), a, stars_end, joined))
    if protos:
        target = max(stop_after(w) for w, *_ in protos)
        out += [(a, b, tabs_to(w, target) + joined) for w, a, b, joined in protos]
    return [e for e in out if v.data[e[0] : e[1]].decode() != e[2]]


def indentation(v: View) -> list[Edit]:
    """Statements and braces that begin a line are as many tabs in as they are deep; what continues a statement stays."""
    wanted: dict[int, int] = {}

    def visit(s: Statement, depth: int) -> None:
        wanted[s.a] = depth
        if s.kind == "block":
            wanted[s.b - 1] = depth
            label = False
            for part in s.parts:
                if part.kind == "label":
                    label = True
                    visit(part, depth + 1)
                else:
                    visit(part, depth + 1 + label)
            return
        for arm in (s.body, s.other):
            if arm is None:
                continue
            if arm is s.other:
                wanted[s.body.b] = depth
            chain = arm is s.other and arm.kind == "if" and v.code[arm.a].line == v.code[arm.a - 1].line
            visit(arm, depth if arm.kind == "block" or chain else depth + 1)
        if s.kind == "do" and s.body is not None:
            wanted[s.body.b] = depth

    for *_, body in v.bodies:
        visit(body, 0)
    out = []
    for i, depth in wanted.items():
        at = v.code[i].start
        a = v.line_start(at)
        if v.first_on_line(at) and v.data[a:at].decode() != "\t" * depth:
            out.append((a, at, "\t" * depth))
    return sorted(out)


def initial_layout(v: View) -> list[Edit]:
    """One tab between type and name of a block's first declarations, and a blank line behind them."""
    out = []
    for *_, body in v.bodies:
        first = shapes.initial(v.t, body)
        for s in first:
            k, parts = v.t.declarators(s)
            if k > s.a and v.code[s.a].line == v.code[s.b - 1].line and v.blank(k) and v.data[slice(*v.gap(k))] != b"\t":
                out.append((*v.gap(k), "\t"))
        if first and len(body.parts) > len(first):
            a, b = v.gap(first[-1].b)
            if v.blank(first[-1].b) and v.data[a:b].count(b"\n") == 1:
                at = a + v.data[a:b].index(b"\n")
                out.append((at, at, "\n"))
    return out


def align_declarations(v: View, lines: set[int] | None = None) -> list[Edit]:
    """The names of each group of first declarations on one tab stop; a group is aligned whole, and only if one of its lines is asked for."""
    out = []
    for *_, body in v.bodies:
        group = []
        for s in shapes.initial(v.t, body):
            k, _ = v.t.declarators(s)
            if k == s.a or v.code[s.a].line != v.code[s.b - 1].line or not v.first_on_line(v.code[s.a].start) or not v.blank(k):
                group = []
                break
            a, b = v.gap(k)
            group.append((v.code[s.a].line, width(v.data[v.line_start(a) : a].decode()), a, b))
        if group and (lines is None or any(g[0] in lines for g in group)):
            target = max(stop_after(g[1]) for g in group)
            out += [(a, b, tabs_to(w, target)) for _, w, a, b in group if v.data[a:b].decode() != tabs_to(w, target)]
    return out


def null_returns(v: View, known: Callable[[int], bool] | None = None) -> list[Edit]:
    """return of 0 where a pointer is returned and NULL is known there."""
    known = known or (lambda at: null_known(v.source, at))
    out = []
    for (_, _, _, body), (*_, pointer) in zip(v.bodies, v.scan.bodies, strict=False):
        for s in body.walk() if pointer else ():
            words = [v.t.word(i) for i in range(s.a + 1, v.t.end(s))] if s.kind == "return" else []
            if [w for w in words if w not in "()"] == ["0"] and known(v.code[s.a].start):
                at = next(i for i in range(s.a + 1, v.t.end(s)) if v.t.word(i) == "0")
                out.append((v.code[at].start, v.code[at].end, "NULL"))
    return out


def null_known(source: str, at: int) -> bool:
    """Whether a directive before a byte defines NULL and none behind it takes it away."""
    known = False
    for d in Scan("", source).lines:
        words = " ".join(t.text for t in d)
        if d[0].start >= at:
            break
        if words == "# include < stddef . h >" or re.fullmatch(r"# define NULL (0|\( \( void \* \) 0 \))", words):
            known = True
        elif re.match(r"# (undef|define) NULL\b", words):
            known = False
    return known


def null_checks(v: View) -> list[Edit]:
    """'x == NULL' becomes '!x' where x is one name or member."""
    out = []
    for *_, body in v.bodies:
        for i in shapes.binary_operators(v.t, body):
            if v.t.word(i) == "==" and v.t.word(i + 1) == "NULL":
                a = i - 1
                while a > 1 and v.t.word(a - 1) in ("->", "."):
                    a -= 2
                alone = v.t.word(a - 1) in ("(", "&&", "||", "=", "return", ",", "!") and v.code[a].kind == "identifier"
                if alone and v.t.word(i + 2) in (")", "&&", "||", ";", ",", "?"):
                    out.append((v.code[a].start, v.code[i + 1].end, "!" + v.text(a, i)))
    return out


def unused_locals(v: View) -> list[Edit]:
    """Declarations alone on their lines of one name that nothing mentions, with a value that does nothing."""
    out = []
    for _, _, s in v.in_blocks():
        if shapes.inert_local(v.t, s, v.uses) and v.clean_tokens(s.a, s.b):
            a, b = v.line_start(v.code[s.a].start), v.code[s.b - 1].end
            end = v.data.find(b"\n", b)
            if v.first_on_line(v.code[s.a].start) and end >= 0 and not v.data[b:end].strip():
                out.append((a, end + 1, ""))
    return out


def remove_comments(v: View, reported: set[tuple[int, int]]) -> list[Edit]:
    """Comments that begin at a reported (line, visual column), with the blanks before them and their line if nothing else is on it."""
    out = []
    for t in v.tokens:
        a = v.line_start(t.start)
        if t.kind.endswith("comment") and (t.line, width(v.data[a : t.start].decode()) + 1) in reported:
            end = v.data.find(b"\n", t.end)
            end = len(v.data) if end < 0 else end
            if not v.data[a : t.start].strip() and not v.data[t.end : end].strip():
                out.append((a, min(len(v.data), end + 1), ""))
            else:
                start = len(v.data[: t.start].rstrip(b" \t"))
                out.append((start, t.end, "" if not v.data[t.end : end].strip() or v.data[t.end : t.end + 1] in (b" ", b"\t") else " "))
    return out


#: Reported rules on blank lines: what is to be done at their line.
BLANK_RULES = {"NL_AFTER_VAR_DECL": "insert", "NEWLINE_PRECEDES_FUNC": "insert", "NL_AFTER_PREPROC": "insert", "EMPTY_LINE_FUNCTION": "delete", "EMPTY_LINE_FILE_START": "delete", "CONSECUTIVE_NEWLINES": "delete", "EMPTY_LINE_EOF": "delete"}


def blank_lines(v: View, reported: Iterable[tuple[str, int]]) -> list[Edit]:
    """A blank line is put before, or taken at, each reported (rule, line)."""
    out, lines = [], v.breaks
    for rule, line in reported:
        if not 1 <= line <= len(lines):
            continue
        a, b = lines[line - 1], lines[line] if line < len(lines) else len(v.data)
        blank = not v.data[a:b].strip()
        if BLANK_RULES.get(rule) == "insert" and not blank and (line == 1 or v.data[lines[line - 2] : a].strip()):
            out.append((a, a, "\n"))
        elif BLANK_RULES.get(rule) == "delete" and blank:
            out.append((a, b, ""))
    return sorted(set(out))


def compact_continuations(v: View) -> list[Edit]:
    """Lines of one statement are joined as long as the whole stays within the columns."""
    out = []
    for s in v.statements():
        if s.kind not in ("expression", "return") or not v.clean_tokens(s.a, s.b) or v.code[s.a].line == v.code[s.b - 1].line:
            continue
        a, b = v.code[s.a].start, v.code[s.b - 1].end
        rows = [r.strip(" \t") for r in v.data[a:b].decode().split("\n")]
        lead, lines = v.indent(a), [rows[0]]
        if any(t.kind == "escaped_newline" for t in v.tokens if a <= t.start < b):
            continue
        for row in rows[1:]:
            glue = "" if lines[-1].endswith(("(", "[")) or row.startswith((")", "]", ";", ",")) else " "
            indent = lead if len(lines) == 1 else lead + "\t"
            if width(indent + lines[-1] + glue + row) <= COLUMNS:
                lines[-1] += glue + row
            else:
                lines.append(row)
        text = f"\n{lead}\t".join(lines)
        if len(lines) < len(rows):
            out.append((a, b, text))
    return out


def wrap_long_lines(v: View) -> list[Edit]:
    """A line over the columns is broken once: before && and ||, else behind a comma, else before another operator; then where nesting is least and the line longest."""
    operators = {i for *_, body in v.bodies for i in shapes.binary_operators(v.t, body)}
    by_line: dict[int, list[int]] = {}
    for i, t in enumerate(v.code):
        by_line.setdefault(t.line, []).append(i)
    depth, nest = 0, []
    for t in v.code:
        depth -= t.text in (")", "]")
        nest.append(depth)
        depth += t.text in ("(", "[")
    out = []
    for line, own in by_line.items():
        a = v.breaks[line - 1]
        b = v.breaks[line] - 1 if line < len(v.breaks) else len(v.data)
        if width(v.data[a:b].decode()) <= COLUMNS or not v.clean(a, b):
            continue
        found = []
        for i in own:
            if i in operators:
                at, rank, k = v.code[i].start, 0 if v.code[i].text in ("&&", "||") else 2, i
            elif v.code[i].text == "," and i + 1 < len(v.code) and v.code[i + 1].line == line and nest[i]:
                at, rank, k = v.code[i].end, 1, i + 1
            else:
                continue
            w = width(v.data[a:at].decode().rstrip())
            if 12 <= w <= COLUMNS and v.code[i].text not in ASSIGN:
                found.append((rank, nest[i], -w, -i, k))
        if found:
            k = min(found)[-1]
            out.append((*v.gap(k), "\n" + v.indent(a) + "\t"))
    return out


def token_spacing(v: View, reported: Iterable[tuple[str, int, int]]) -> list[Edit]:
    """Blanks at reported (rule, line, visual column): put before or behind an operator, taken beside parentheses, several made one, tabs made blanks."""
    at: dict[tuple[int, int], int] = {}
    for k, t in enumerate(v.tokens):
        at[t.line, width(v.data[v.line_start(t.start) : t.start].decode()) + 1] = k
    out = []
    for rule, line, column in reported:
        k = at.get((line, column))
        if k is None:
            continue
        t = v.tokens[k]
        before = v.tokens[k - 1] if k else None
        behind = v.tokens[k + 1] if k + 1 < len(v.tokens) else None
        blank = lambda x: x is not None and x.kind in ("space", "tab")
        if rule in ("SPC_BFR_OPERATOR", "SPC_BFR_POINTER") and before is not None and before.kind not in TRIVIA:
            out.append((t.start, t.start, " "))
        elif rule in ("SPC_AFTER_OPERATOR", "SPACE_AFTER_KW") and behind is not None and behind.kind not in TRIVIA:
            out.append((t.end, t.end, " "))
        elif rule in ("NO_SPC_BFR_OPR", "NO_SPC_BFR_PAR") and blank(before):
            out.append((before.start, before.end, ""))
        elif rule in ("NO_SPC_AFR_OPR", "NO_SPC_AFR_PAR", "SPC_AFTER_POINTER") and blank(behind):
            out.append((behind.start, behind.end, ""))
        elif rule in ("CONSECUTIVE_SPC", "CONSECUTIVE_WS", "TAB_INSTEAD_SPC") and blank(t) and not v.first_on_line(t.start):
            end = t.end
            while blank(behind) and behind.start == end:
                k, end = k + 1, behind.end
                behind = v.tokens[k + 1] if k + 1 < len(v.tokens) else None
            out.append((t.start, end, " "))
        elif rule == "SPC_LINE_START" and blank(t) and v.first_on_line(t.start):
            out.append((t.start, t.end, ""))
    return sorted(set(out))


#: In the order in which the schedule tries them; True: white space alone may change.
SCHEDULE: dict[str, tuple[Callable[[View], list[Edit]], bool]] = {
    "REMOVE_SINGLE_STATEMENT_BRACES": (single_braces, False),
    "REMOVE_REDUNDANT_ELSE": (redundant_else, False),
    "ONE_DECLARATION_PER_LINE": (one_declaration, False),
    "SPLIT_DECLARATION_ASSIGNMENT": (split_declarations, False),
    "SPLIT_CHAINED_ASSIGNMENT": (chained, False),
    "REPLACE_FOR_LOOP": (for_loops, False),
    "REPLACE_TERNARY": (ternaries, False),
    "POINTER_NULL_RETURN": (null_returns, False),
    "ELSE_NEWLINE": (else_newline, True),
    "CONTROL_BRACE_NEWLINE": (brace_newline, True),
    "CONTROL_BODY_NEWLINE": (body_newline, True),
    "BLOCK_STATEMENT_NEWLINE": (block_newline, True),
    "ONE_INSTRUCTION_PER_LINE": (crowded, True),
    "OPERATOR_SPACING": (operator_spacing, True),
    "COMPACT_CONTINUATION": (compact_continuations, True),
    "FUNCTION_LAYOUT": (function_layout, True),
    "INDENTATION": (indentation, True),
    "INITIAL_DECLARATION_LAYOUT": (initial_layout, True),
    "LINE_TOO_LONG": (wrap_long_lines, True),
}
#: Rewrites that are asked for by name.
ASKED = {"REMOVE_UNUSED_VARIABLE": unused_locals, "COMPACT_NULL_CHECK": null_checks, "DECLARATION_ALIGNMENT": align_declarations}


def rewritten(source: str, edits_of: Callable[[View], list[Edit]]) -> str:
    """The source after one rewrite; as it was if the edits conflict."""
    edits = edits_of(view(source))
    return source if not edits or conflicts(edits) else apply_edits(source, edits)
