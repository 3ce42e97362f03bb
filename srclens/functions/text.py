"""Text geometry and hygiene as Column functions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "﻿"
TAB_STOP = 4
#: Code point ranges shown two columns wide, in a Java regex class.
WIDE = r"[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
COMBINING = r"[\p{Mn}\p{Me}\p{Cf}]"


def remove_bom(t: Column) -> Column:
    return F.when(t.startswith(BOM), F.substring(t, 2, 1 << 30)).otherwise(t)


def normalize_eol(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trim_trailing(t: Column) -> Column:
    """Blanks and tabs at line ends go, but not behind a backslash."""
    return F.regexp_replace(t, r"(?<![ \t\\])[ \t]+(?=\n|\z)", "")


def drop_leading_blank(t: Column) -> Column:
    return F.ltrim(t, F.lit("\n"))


def collapse_blank(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def final_newline(t: Column) -> Column:
    return F.when(F.rtrim(t, F.lit("\n")) == "", F.lit("")).otherwise(F.concat(F.rtrim(t, F.lit("\n")), F.lit("\n")))


HYGIENE = [
    ("REMOVE_BOM", remove_bom),
    ("NORMALIZE_EOL", normalize_eol),
    ("TRIM_TRAILING_WHITESPACE", trim_trailing),
    ("DROP_LEADING_BLANK_LINES", drop_leading_blank),
    ("COLLAPSE_BLANK_LINES", collapse_blank),
    ("FINAL_NEWLINE", final_newline),
]


def hygiene(t: Column) -> Column:
    for _, step in HYGIENE:
        t = step(t)
    return t


def plain_width(t: Column) -> Column:
    """Columns of a text without tabs: combining characters take none, wide ones two."""
    simple = F.octet_length(t) == F.char_length(t)
    return F.when(simple, F.char_length(t)).otherwise(F.char_length(t) - F.regexp_count(t, F.lit(COMBINING)) + F.regexp_count(t, F.lit(WIDE)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def visual_width(line: Column) -> Column:
    """Columns of a line; every tab goes on to the next stop."""
    parts = F.split(line, "\t", -1)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    stops = F.aggregate(before, F.lit(0), lambda n, p: n + (F.floor(plain_width(p) / TAB_STOP).cast("int") + 1) * TAB_STOP)
    return F.when(F.instr(line, "\t") == 0, plain_width(line)).otherwise(stops + plain_width(F.element_at(parts, -1)))


def guard_name(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def identifiers(code: Column) -> Column:
    """Runs of letters, digits and underscores that don't begin with a digit."""
    return F.filter(F.split(code, "[^A-Za-z0-9_]+", -1), lambda x: x.rlike("^[A-Za-z_]"))


def remove_splices(t: Column) -> Column:
    return F.regexp_replace(t, r"(\\|[?][?]/)\r?\n", "")


#: A closed block comment, matched without going back.
BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
#: What C code is cut into where only comments and literals matter: these, then words and numbers, then what begins none of them, then any character.
LINE_COMMENT = r"//[^\\\n]*+(?:\\(?:\r?\n)?[^\\\n]*+)*+"
STRING = r'(?:u8|[uUL])?"[^"\\\n]*+(?:\\(?:\r\n|(?s:.))[^"\\\n]*+)*+"'
CHARACTER = r"[uUL]?'(?:[^'\\\n]++|\\(?:\r\n|(?s:.)))++'"
CODE = "|".join([LINE_COMMENT, BLOCK_COMMENT, STRING, CHARACTER, r"\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*+", r"[A-Za-z_][A-Za-z0-9_]*+", r"""[^A-Za-z0-9_"'/.]++""", r"(?s:.)"])


def trivia_only(code: Column) -> Column:
    """White space and comments alone; an open block comment is not."""
    return code.rlike(rf"\A(?:\s++|//[^\n]*+|{BLOCK_COMMENT})*+\z")


def masked(code: Column) -> Column:
    """C code with comments and literals blanked; every line keeps its length.  What is not closed stays."""
    hidden = r"""\A(?://|/\*|(?:u8|[uUL])?"(?s:.)|[uUL]?'(?s:.))"""
    parts = F.regexp_extract_all(code, F.lit(CODE), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(hidden), F.regexp_replace(t, "[^\n]", " ")).otherwise(t)), "")


def wrapped(t: Column, most: int = 80) -> Column:
    """Words on lines of at most ``most`` characters, as many on each as fit; a longer word has a line of its own."""
    words = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return F.regexp_replace(F.regexp_replace(words, rf"([^ ]{{{most + 1},}}|.{{1,{most}}})( |$)", "$1\n"), r"\n\z", "")


def packed(words: Column, first: Column | str, rest: str = "\t", most: int = 80) -> Column:
    """Words (array<string>) on lines joined by ' \\', the first behind ``first``, the others behind ``rest``; null if one doesn't fit.

    Tabs go to the next stop of four.  Only the last line needs no room for ' \\'.
    """
    first = F.lit(first) if isinstance(first, str) else first
    room = F.lit(most) - visual_width(first)
    later = most - len(rest.expandtabs(4))
    line = lambda n: rf"(?:.{{1,{n}}}$|.{{1,{n - 2}}}(?= ))"
    # as ``line``, with as much room as ``first`` leaves
    begin = F.when(room > 2, F.concat(F.lit(r"\A(?:.{1,"), room.cast("string"), F.lit("}$|.{1,"), (room - 2).cast("string"), F.lit("}(?= ))"))).otherwise(r"(?!)")

    def with_tail(tail: Column, head: Column) -> Column:
        lines = F.regexp_extract_all(tail, F.lit(rf"({line(later)})(?: |$)"), F.lit(1))
        # of what is left for later lines the last word needs no room behind it, the others do
        fits = lambda left: F.forall(F.slice(left, 1, F.size(left) - 1), lambda w: F.char_length(w) <= later - 2) & (F.char_length(F.element_at(left, -1)) <= later)
        rest_lines = F.transform(F.when(tail == "", F.array()).otherwise(lines), lambda x: F.concat(F.lit(rest), x))
        return F.when((tail == "") | bound(F.split(tail, " "), fits), F.array_join(F.concat(F.array(F.concat(first, head)), rest_lines), " \\\n"))

    def with_head(head: Column, text: Column) -> Column:
        tail = F.substring(text, F.char_length(head) + F.when(head == "", 1).otherwise(2), F.char_length(text))
        return bound(tail, lambda t: with_tail(t, head))

    return bound(F.array_join(words, " "), lambda text: bound(F.coalesce(F.regexp_substr(text, begin), F.lit("")), lambda head: with_head(head, text)))


#: White space and comments.
_GAP = rf"(?:\s++|//[^\n]*+|{BLOCK_COMMENT})*+"


def guarded(code: Column, guard: Column) -> Column:
    """Whether the whole of a header stands between the canonical guard's lines."""
    lines = F.regexp_extract_all(masked(code), F.lit(r"(?m)^[ \t]*+#[ \t]*+([^\n]*+)$"), F.lit(1))
    one = lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r" $", "")
    return (F.size(lines) >= 3) & (one(F.get(lines, F.lit(0))) == F.concat(F.lit("ifndef "), guard)) & (one(F.get(lines, F.lit(1))) == F.concat(F.lit("define "), guard)) & F.coalesce(one(F.try_element_at(lines, F.lit(-1))) == "endif", F.lit(False))


def with_guard(code: Column, guard: Column) -> Column:
    """A header with its canonical guard: as it is if it has it, renamed if the whole stands in another, else put round it."""
    other = F.regexp_extract(code, rf"\A{_GAP}#[ \t]*+ifndef[ \t]++(\w++)", 1)
    renamed = F.regexp_replace(code, F.lit(rf"\A({_GAP}#[ \t]*+ifndef[ \t]++)(\w++)({_GAP}#[ \t]*+define[ \t]++)\2(?=\s)"), F.concat(F.lit("$1"), guard, F.lit("$3"), guard))
    added = F.concat(F.lit("#ifndef "), guard, F.lit("\n# define "), guard, F.lit("\n\n"), F.regexp_replace(code, r"\n+\z", ""), F.lit("\n\n#endif\n"))
    return F.when(guarded(code, guard), code).when((other != "") & guarded(code, other), renamed).otherwise(added)


def strip_ansi(t: Column) -> Column:
    return F.regexp_replace(t, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def word_list(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{name} is replaced; what has no value stays visible."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v.cast("string"))
    return template


def plural(n: Column, locale: Column) -> Column:
    """Whether a count takes the singular: 0 does in French."""
    return F.when(F.when(locale == "fr", n <= 1).otherwise(n == 1), F.lit("one")).otherwise(F.lit("other"))


def locale_of(tag: Column, known: tuple[str, ...] = ("en", "fr", "es", "de")) -> Column:
    first = F.lower(F.split(tag, "[-_.@:]")[0])
    return F.when(first.isin(*known), first).otherwise(F.lit("en"))


def file_kind(path: Column) -> Column:
    name = F.regexp_extract(path, "[^/]+$", 0)
    return (
        F.when(name.endswith(".c"), "c_source")
        .when(name.endswith(".h"), "c_header")
        .when(F.lower(name) == "makefile", "makefile")
        .when((name == "README") | name.startswith("README."), "markdown")
    )


def valid_path(path: Column) -> Column:
    """Relative, no empty, '.' or '..' part, no backslash, no control character."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)(\.{0,2})(/|$)") & ~path.rlike(r"[\\\x00-\x1F]"), F.lit(False))


def comma_count(declaration: Column) -> Column:
    """Commas outside brackets; a bracket that closes nothing doesn't count."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "[", "{"), acc.depth + 1).when(c.isin(")", "]", "}"), F.greatest(acc.depth - 1, F.lit(0))).otherwise(acc.depth)
        return F.struct(depth.alias("depth"), (acc.n + F.when((c == ",") & (acc.depth == 0), 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(declaration, ""), start, step, lambda acc: acc.n)


def escape_inline(t: Column) -> Column:
    """Control characters made visible: line feed, carriage return and tab by their letter, others by their number."""
    shown = F.transform(F.split(t, ""), lambda c: F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c.rlike(r"\p{Cc}"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c))
    return F.when(t.rlike(r"\p{Cc}"), F.array_join(shown, "")).otherwise(t)


def duration(seconds: Column) -> Column:
    """Micro- and milliseconds whole, seconds with two places, minutes with what is left; halves go to the even digit."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 0.001, F.format_string("%.0f µs", F.bround(seconds * 1e6)))
        .when(seconds < 1, F.format_string("%.0f ms", F.bround(seconds * 1e3)))
        .when(seconds < 60, F.format_string("%.2f s", F.bround(seconds, 2)))
        .otherwise(F.format_string("%d min %.1f s", minutes, F.bround(seconds - minutes * 60, 1)))
    )


def offset_of(content: Column, line: Column, column: Column, visual: bool = True) -> Column:
    """The byte offset of a line and column from 1, visual or in bytes; beyond a line's end its end, null beyond the text."""

    def at(rows: Column) -> Column:
        own = F.get(rows, line - 1)
        before = F.octet_length(F.array_join(F.slice(rows, F.lit(1), F.greatest(line - 1, F.lit(0))), "\n")) + F.when(line > 1, 1).otherwise(0)
        # one pass over the characters: the width up to each, and how many end before the column
        width = lambda w, c: F.when(c == "\t", w + TAB_STOP - w % TAB_STOP).otherwise(w + plain_width(c)).cast("int")
        step = lambda acc, c: F.struct(width(acc["w"], c).alias("w"), (acc["n"] + (width(acc["w"], c) < column).cast("int")).alias("n"))
        places = F.aggregate(F.regexp_extract_all(own, F.lit("(?s)."), F.lit(0)), F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
        inside = F.octet_length(F.substring(own, F.lit(1), places)) if visual else F.least(column - 1, F.octet_length(own))
        return F.when((line > 0) & own.isNotNull() & (column > 0), before + inside)

    return bound(F.split(content, "\n", -1), at)
