"""Rewrites of C sources, one file at a time, under a fixed-point schedule.

A rewrite is a function from tokens to texts.  Layout rewrites must leave the
significant tokens as they were; a rewrite that doesn't, or whose result is not
safe, is refused for that file and the file stays as it was.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import rewrites
from .facts import KEYWORDS, TYPES, Scan
from .lexer import TRIVIA, Token

BLANK = frozenset(["space", "tab"])
CONTROL = frozenset(["if", "while", "for", "switch", "return"])
MAX_PASSES = 16


#: The last tokens asked for and their answer: every rewrite asks about the same ones while none changes them.
_ASKED: list = [None, None]


def in_directive(tokens: list[Token]) -> list[bool]:
    """Whether each token belongs to a preprocessor line."""
    if _ASKED[0] is not tokens:
        _ASKED[:] = tokens, _in_directive(tokens)
    return _ASKED[1]


def _in_directive(tokens: list[Token]) -> list[bool]:
    out, fresh, inside = [], True, False
    for t in tokens:
        if t.kind == "newline":
            fresh, inside = True, False
        elif t.kind not in TRIVIA:
            inside = inside or (fresh and t.text == "#")
            fresh = False
        out.append(inside)
    return out


def behind(tokens: list[Token], i: int, step: int = 1) -> int | None:
    """The next token that is no trivia, in either direction."""
    i += step
    while 0 <= i < len(tokens):
        if tokens[i].kind not in TRIVIA:
            return i
        i += step
    return None


def edge(tokens: list[Token], i: int, step: int) -> bool:
    """Whether only blanks lie between token i and its line's edge."""
    i += step
    while 0 <= i < len(tokens) and tokens[i].kind in BLANK:
        i += step
    return not 0 <= i < len(tokens) or tokens[i].kind in ("newline", "escaped_newline", "line_comment", "block_comment")


def _spaced(tokens: list[Token], places: frozenset[str], wanted: Callable[[int], tuple[str | None, str | None]]) -> list[str]:
    """Texts in which the blanks before and behind token i are what wanted(i) gives; None leaves them, line edges stay.  places: the texts of the tokens asked about."""
    out = [t.text for t in tokens]
    for i in [i for i, text in enumerate(out) if text in places]:
        for step, text in zip((-1, 1), wanted(i), strict=True):
            if text is None or edge(tokens, i, step):
                continue
            j = i + step
            while 0 <= j < len(tokens) and tokens[j].kind in BLANK:
                out[j] = ""
                j += step
            out[i] = text + out[i] if step < 0 else out[i] + text
    return out


def comma_spacing(tokens: list[Token]) -> list[str]:
    skip = in_directive(tokens)
    return _spaced(tokens, frozenset(","), lambda i: ("", " ") if tokens[i].kind == "punct" and not skip[i] else (None, None))


def keyword_spacing(tokens: list[Token]) -> list[str]:
    skip = in_directive(tokens)

    def wanted(i: int):
        n = behind(tokens, i)
        return (None, " ") if n is not None and tokens[n].text == "(" and not skip[i] else (None, None)

    return _spaced(tokens, CONTROL, wanted)


def subscript_spacing(tokens: list[Token]) -> list[str]:
    skip = in_directive(tokens)
    return _spaced(tokens, frozenset("[]"), lambda i: (None, "") if tokens[i].text == "[" and not skip[i] else ("", None) if tokens[i].text == "]" and not skip[i] else (None, None))


def pointer_spacing(tokens: list[Token]) -> list[str]:
    """No blank behind a star that follows a type word or another such star."""
    skip, star = in_directive(tokens), set()
    for i, t in enumerate(tokens):
        if t.text == "*" and not skip[i] and (p := behind(tokens, i, -1)) is not None and (tokens[p].text in TYPES or p in star):
            star.add(i)
    return _spaced(tokens, frozenset("*"), lambda i: (None, "") if i in star and (n := behind(tokens, i)) is not None and tokens[n].text not in KEYWORDS else (None, None))


def directive_spacing(tokens: list[Token]) -> list[str]:
    """One blank per open conditional between '#' and its word; a header's guard doesn't count for itself."""
    out, depth, skip = [t.text for t in tokens], 0, in_directive(tokens)
    for i, t in enumerate(tokens):
        if t.text != "#" or not skip[i] or (i and skip[i - 1] and tokens[i - 1].kind != "newline"):
            continue
        n = behind(tokens, i)
        if n is None or not skip[n] or tokens[n].line != t.line:
            continue
        word = tokens[n].text
        if word in ("endif", "else", "elif"):
            depth = max(0, depth - 1)
        for j in range(i + 1, n):
            out[j] = "" if tokens[j].kind in BLANK else out[j]
        out[i] = "#" + " " * depth
        if word in ("if", "ifdef", "ifndef", "else", "elif"):
            depth += 1
    return out


def block_edges(tokens: list[Token]) -> list[str]:
    """No blank lines behind '{' or before '}'."""
    out = [t.text for t in tokens]
    for i, t in enumerate(tokens):
        for here, step in (("{", 1), ("}", -1)):
            if t.text != here or t.kind != "punct":
                continue
            j, line = i + step, []
            while 0 <= j < len(tokens) and tokens[j].kind in BLANK | {"newline"}:
                line.append(j)
                j += step
            ends = [k for k in line if tokens[k].kind == "newline"]
            if len(ends) > 1:
                drop = range(ends[0] + 1, ends[-1] + 1) if step > 0 else range(ends[-1] + 1, ends[0] + 1)
                for k in drop:
                    out[k] = ""
    return out


def return_parenthesis(tokens: list[Token]) -> list[str]:
    out, skip = [t.text for t in tokens], in_directive(tokens)
    for i, t in enumerate(tokens):
        if t.text != "return" or skip[i]:
            continue
        a, depth, whole, j = behind(tokens, i), 0, True, behind(tokens, i)
        last = None
        while j is not None and tokens[j].text != ";" and not skip[j]:
            depth += (tokens[j].text in "([{") - (tokens[j].text in ")]}") if tokens[j].kind == "punct" else 0
            n = behind(tokens, j)
            if depth == 0 and n is not None and tokens[n].text != ";":
                whole = False
            last, j = j, n
        if last is None or j is None or skip[j] or (tokens[a].text == "(" and whole):
            continue
        out[a] = "(" + out[a]
        out[last] += ")"
    return out


def no_args_void(tokens: list[Token]) -> list[str]:
    """'()' of a definition at file level becomes '(void)'."""
    out, depth = [t.text for t in tokens], 0
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        depth += (t.text == "{") - (t.text == "}")
        n = behind(tokens, i)
        p = behind(tokens, i, -1)
        if t.text == "(" and depth == 0 and n is not None and tokens[n].text == ")" and p is not None and tokens[p].kind == "identifier" and tokens[p].text not in KEYWORDS:
            b = behind(tokens, n)
            if b is not None and tokens[b].text == "{":
                out[i] = "(void"
    return out


def empty_statements(tokens: list[Token]) -> list[str]:
    """A ';' right behind ';' or '{' goes, with the blanks before it and its line if it has one to itself; not in parentheses, not behind a directive or a type's end."""
    out, skip, depth = [t.text for t in tokens], in_directive(tokens), 0
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        depth += (t.text in "([") - (t.text in ")]")
        p = behind(tokens, i, -1)
        if t.text == ";" and depth == 0 and p is not None and not skip[p] and tokens[p].text in (";", "{"):
            out[i] = ""
            j = i - 1
            while j >= 0 and tokens[j].kind in BLANK:
                out[j] = ""
                j -= 1
            if j >= 0 and tokens[j].kind == "newline" and edge(tokens, i, 1):  # alone on its line
                out[j] = ""
    return out


LAYOUT = {"COMMA_SPACING": comma_spacing, "CONTROL_KEYWORD_SPACING": keyword_spacing, "SUBSCRIPT_SPACING": subscript_spacing, "POINTER_SPACING": pointer_spacing, "PREPROCESSOR_SPACING": directive_spacing, "BLOCK_EDGE_BLANK_LINE": block_edges}
REWRITES = {"REMOVE_EMPTY_STATEMENT": empty_statements, "NO_ARGS_VOID": no_args_void, "RETURN_PARENTHESIS": return_parenthesis}


def significant(source: str) -> list[tuple[str, str]]:
    return [(t.kind, t.text) for t in rewrites.view(source).tokens if t.kind not in TRIVIA or t.kind.endswith("comment")]


def safe(source: str) -> bool:
    return rewrites.view(source).scan.safe


def _by_tokens(rewrite: Callable[[list[Token]], list[str]]) -> Callable[[str], str]:
    return lambda source: "".join(rewrite(rewrites.view(source).tokens))


#: Every rewrite in the order it is tried, as (source to source, whether white space alone may change).
PHASES: dict[str, tuple[Callable[[str], str], bool]] = {k: (_by_tokens(f), False) for k, f in REWRITES.items()}
PHASES |= {k: (lambda source, f=f: rewrites.rewritten(source, f), layout) for k, (f, layout) in rewrites.SCHEDULE.items() if not layout}
PHASES |= {k: (_by_tokens(f), True) for k, f in LAYOUT.items()}
PHASES |= {k: (lambda source, f=f: rewrites.rewritten(source, f), layout) for k, (f, layout) in rewrites.SCHEDULE.items() if layout}


def proved(before: str, after: str, layout: bool) -> bool:
    """Whether a candidate may take a source's place: it is safe, and a layout rewrite leaves the significant tokens and comments."""
    return safe(after) and (not layout or significant(after) == significant(before))


def fix(source: str, asked: tuple[str, ...] = (), only: frozenset[str] | None = None) -> tuple[str, dict[str, int]]:
    """The source after all rewrites, repeated until none changes it, and how many lines each changed.

    asked: rewrites of ``rewrites.ASKED`` that are run as well.  A source that
    comes back (by its digest) or doesn't settle in ``MAX_PASSES`` is left as it
    was at the start.
    """
    counts: dict[str, int] = {}
    if not safe(source):
        return source, counts
    phases = {k: v for k, v in PHASES.items() if only is None or k in only}
    own = {k: (lambda source, f=rewrites.ASKED[k]: rewrites.rewritten(source, f), k == "DECLARATION_ALIGNMENT") for k in asked}
    # what is unused goes before it is taken apart; what is aligned comes last
    phases = {k: v for k, v in own.items() if not v[1]} | phases | {k: v for k, v in own.items() if v[1]}
    first, seen = source, {hash(source)}
    left: dict[str, str] = {}  # by rewrite: the source that it has already left as it was
    for _ in range(MAX_PASSES):
        before = source
        for name, (rewrite, layout) in phases.items():
            if left.get(name) == source:
                continue
            new = rewrite(source)
            if new == source or not proved(source, new, layout):
                left[name] = source
                continue
            counts[name] = counts.get(name, 0) + sum(a != b for a, b in zip(source.split("\n"), new.split("\n"), strict=False)) + abs(source.count("\n") - new.count("\n"))
            source = new
        if source == before:
            return source, counts
        if hash(source) in seen:
            break
        seen.add(hash(source))
    return first, {}


def fixed(sources: DataFrame, asked: tuple[str, ...] = (), only: frozenset[str] | None = None, diffs: bool = True) -> DataFrame:
    """(path, content, changed, fixes, diff, failure) of sources (path, content); asked and only as of ``fix``; diff is null if not diffs.

    A file that can't be worked on keeps its content and says why; the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0), b.column(1), strict=True):
                name, old = path.as_py(), content.as_py() or ""
                failure = None
                try:
                    new, counts = fix(old, asked, only)
                except (RecursionError, ValueError) as e:
                    new, counts, failure = old, {}, f"{type(e).__name__}: {e}"
                diff = None if not diffs else "" if new == old else "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{name}", f"b/{name}"))
                rows.append((name, new, new != old, sorted(counts.items()), diff, failure))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.int64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["path", "content", "changed", "fixes", "diff", "failure"])

    return sources.select("path", "content").mapInArrow(run, "path string, content string, changed boolean, fixes map<string, bigint>, diff string, failure string")
