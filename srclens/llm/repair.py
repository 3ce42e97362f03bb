"""Conversation structure repair (operator 11): lazy weighted determinisation.

Rows of a conversation are taken by turn (nulls first), then role and text.  A
row's first fault counts: blank, duplicate (role and text stand earlier in the
conversation), truncated (the last character that is no white space is none of
``.!?``).  The cheapest edits (keep, re-role, delete, insert) are sought that
make the roles match ``(s?(ua)+)?``; among equally cheap ones those whose
initials are ASCII-least.  See ``automaton`` for the method.

A conversation of at most ``LONG`` rows and ``LONG_BYTES`` bytes is scanned by
one task.  A longer one is range-partitioned by its rows: each block of
``BLOCK`` rows gives a matrix of four by four costs, the matrices give the
vector behind every block, a trace of every block from each of the four states
gives where it leads, and these give the state before it.  Only what one task
must do goes to one: the running SHA-256 of the repaired text, which is read in
order and never held.  Both ways give the same rows.

Defined results.  A null role or text is one space; a row whose id is null
belongs to the conversation of null.  Null turns come first and count for no
gap.  Repeated rows are duplicates, whatever their turn.  An empty table has no
conversations.  Texts may be of any length.  Other columns are not read, so
their names may clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton, Costs, through
from .common import Workspace

LONG, LONG_BYTES = 1 << 16, 1 << 26
BLOCK = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
ORDER = ("conv", "turn", "role", "text")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def symbols(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, symbol): the symbol of each row as the automaton takes it, but for duplicates."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    body = F.rtrim(text, F.lit(SPACES))
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(body == "", "x").when(F.substring(body, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    return rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), symbol.alias("symbol"))


class Report:
    """What is said of a conversation, from its rows in order with what is done to each; holds none of them."""

    def __init__(self, costs: Costs):
        self.costs, self.audit, self.sha, self.lines = costs, [], hashlib.sha256(), 0
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.faults, self.illegal, self.cost, self.initial = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, None

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def edits(self, token: str, role: str = "", text: str = "", truncated: bool = False) -> None:
        at = 0
        while at < len(token):
            kind = token[at]
            self.audit.append(kind)
            if kind in "IR":
                self.cost += self.costs.insert if kind == "I" else self.costs.rerole
                self.line(ROLES[token[at + 1]], "" if kind == "I" else text)
            elif kind == "K":
                self.line(role, text)
            else:
                self.cost += self.costs.delete
            self.cost += self.costs.truncated * (kind in "KR" and truncated)
            at += 2 if kind in "IR" else 1

    def row(self, turn: int | None, role: str, text: str, symbol: str, duplicate: bool, token: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        truncated = symbol.isupper() and not duplicate
        if symbol == "x" or duplicate or truncated:
            self.faults["blank" if symbol == "x" else "duplicate" if duplicate else "truncated"] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.edits(token, role, text, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _batch(convs: list, results: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*results, strict=True) if results else [[]] * (len(schema) - 1)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip([convs, *columns], schema, strict=True)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _schema(conv: pa.DataType) -> pa.Schema:
    names = [(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (x.split()[0] for x in RESULT.split(", "))]
    return pa.schema([("conv", conv), *names])


def whole_conversations(costs: Costs):
    """Rows sorted by conversation to one result a conversation; holds one conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, held, convs, out, schema = Automaton(costs), [], [], [], None

        def close() -> None:
            seen, marks = set(), []
            for _, _, role, text, symbol in held:
                marks.append((role, text) in seen)
                seen.add((role, text))
            line = "".join("x" if m else h[4] for m, h in zip(marks, held, strict=True))
            behind, vector = machine.scan(line, machine.end)
            tokens, last = machine.trace(line, behind, 0)
            report = Report(costs)
            for (_, turn, role, text, symbol), mark, token in zip(held, marks, tokens, strict=True):
                report.row(turn, role, text, symbol, mark and symbol != "x", token)
            report.edits(machine.closing(last))
            assert report.cost == vector[0]
            convs.append(held[0][0])
            out.append(report.result())

        for b in batches:
            schema = schema or _schema(b.schema.field("conv").type)
            for row in _runs([b], [*ORDER, "symbol"]):
                if held and held[0][0] != row[0]:
                    close()
                    held.clear()
                held.append(row)
            if len(convs) >= 1024:
                yield _batch(convs, out, schema)
                convs, out = [], []
        if held:
            close()
        if convs:
            yield _batch(convs, out, schema)

    return run


def streamed(costs: Costs):
    """Rows of long conversations in order, with the token of each, to one result a conversation; holds no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, report, schema = None, None, None
        for b in batches:
            schema = schema or _schema(b.schema.field("conv").type)
            for conv, turn, role, text, symbol, duplicate, token, closing in _runs([b], [*ORDER, "symbol", "duplicate", "token", "closing"]):
                if report is None or conv != now:
                    if report is not None:
                        yield _batch([now], [report.result()], schema)
                    now, report = conv, Report(costs)
                report.row(turn, role, text, symbol, duplicate, token)
                report.edits(closing or "")
        if report is not None:
            yield _batch([now], [report.result()], schema)

    return run


def _matrices(costs: Costs):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        line = "".join(rows["symbol"])
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "first": rows["at"].iloc[:1], "line": [line], "matrix": [[x for r in Automaton(costs).matrix(line) for x in r]]})

    return run


def _vectors(costs: Costs):
    """The blocks of a conversation from the last to the first: the vector behind each."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("first", ascending=False)
        vector, behind = list(Automaton(costs).end), []
        for m in blocks["matrix"]:
            behind.append(vector)
            vector = through([m[0:4], m[4:8], m[8:12], m[12:16]], vector)
        return pd.DataFrame({"first": blocks["first"], "behind": behind})

    return run


def _traces(costs: Costs):
    """Each block traced from each of the four states."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Automaton(costs)
        for f in frames:
            made = []
            for line, vector in zip(f["line"], f["behind"], strict=True):
                behind = machine.scan(line, tuple(int(v) for v in vector))[0]
                made.append([machine.trace(line, behind, q) for q in range(4)])
            yield pd.DataFrame({"conv": f["conv"], "first": f["first"], "exits": [[t[1] for t in m] for m in made], "tokens": [[" ".join(t[0]) for t in m] for m in made]})

    return run


def _entries(costs: Costs):
    """The blocks of a conversation from the first to the last: the state before each, and what is put behind the last."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("first")
        q, entry = 0, []
        for exits in blocks["exits"]:
            entry.append(q)
            q = int(exits[q])
        closing = [""] * (len(entry) - 1) + [Automaton(costs).closing(q)]
        return pd.DataFrame({"first": blocks["first"], "entry": entry, "closing": closing})

    return run


def long_conversations(rows: DataFrame, ws: Workspace, costs: Costs, block: int = BLOCK) -> DataFrame:
    """Results of conversations that are too long for one task; rows have a number ``salt``, so that equal ones can be split too."""
    conv = rows.schema["conv"].dataType.simpleString()
    order = [*ORDER, "salt"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a partition's rows are numbered in their order, so that places grow with the order of all rows
    placed = ws.save(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("salt"), "placed")
    firsts = placed.groupBy("conv", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    marked = placed.select("conv", "at", "symbol").join(firsts, "at", "left").withColumn("duplicate", F.coalesce("again", F.lit(True)) & (F.col("symbol") != "x"))
    marked = ws.save(marked.drop("again"), "marked")
    light = marked.select("conv", "at", F.when(F.col("duplicate"), "x").otherwise(F.col("symbol")).alias("symbol"), F.floor(F.col("at") / block).alias("block"))
    blocks = ws.save(light.groupBy("conv", "block").applyInPandas(_matrices(costs), f"conv {conv}, first long, line string, matrix array<long>"), "blocks")
    vectors = blocks.select("conv", "first", "matrix").groupBy("conv").applyInPandas(_vectors(costs), "first long, behind array<long>")
    traces = blocks.select("conv", "first", "line").join(vectors, "first").mapInPandas(_traces(costs), f"conv {conv}, first long, exits array<long>, tokens array<string>")
    traces = ws.save(traces, "traces")
    entries = traces.select("conv", "first", "exits").groupBy("conv").applyInPandas(_entries(costs), "first long, entry long, closing string")
    tokens = traces.select("first", "tokens").join(entries, "first").select("first", F.split(F.get("tokens", F.col("entry").cast("int")), " ").alias("tokens"), "closing")
    done = tokens.select("first", F.size("tokens").alias("n"), "closing", F.posexplode("tokens").alias("pos", "token"))
    done = done.select((F.col("first") + F.col("pos")).alias("at"), "token", F.when(F.col("pos") == F.col("n") - 1, F.col("closing")).alias("closing"))
    ready = placed.join(marked.select("at", "duplicate"), "at").join(done, "at")
    return ready.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(streamed(costs), f"conv {conv}, {RESULT}")


def repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), long: int = LONG, long_bytes: int = LONG_BYTES, block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row a conversation that has rows."""
    ws = Workspace(rows.sparkSession, "repair")
    read = symbols(rows, id_col, turn_col, role_col, text_col)
    conv = read.schema["conv"].dataType.simpleString()
    sizes = read.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes"))
    # at most one conversation in LONG rows or LONG_BYTES bytes is long
    big = ws.save(sizes.where((F.col("n") > long) | (F.col("bytes") > long_bytes)).select(F.struct("conv").alias("big")), "long")
    is_big = F.struct(read["conv"]) == big["big"]
    short = read.join(big, is_big, "left_anti").repartition("conv").sortWithinPartitions(*ORDER)
    out = short.mapInArrow(whole_conversations(costs), f"conv {conv}, {RESULT}")
    if big.isEmpty():
        return out
    rest = read.withColumn("salt", F.monotonically_increasing_id()).join(big, is_big, "left_semi")
    return out.unionByName(long_conversations(rest, ws, costs, block))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by the checksum of ``conv_id:turn`` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(space("role"))
    rows = conversations.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


EMPTY = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def of_all(conversations: DataFrame, **options) -> DataFrame:
    """The repair of the damaged conversations, with zeros for those of which no row is left."""
    found = repaired(damaged(conversations), **options)
    ids = conversations.select("conv_id").distinct()
    values = [F.coalesce(found[c], F.lit(EMPTY.get(c, 0))).alias(c) for c in found.columns[1:]]
    return ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left").select("conv_id", *values)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_all(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# SQL: the checksum byte by byte by its polynomial, then the least (cost, audit) of each of the four states row by row.
_BITS = "list_reduce(list_prepend({v}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {_BITS.format(v='xor(c, b)')}), 4294967295)"
_NEXT = {"n": "u", "s": "u", "u": "a", "a": "u"}
_KEPT = {"n": {"s": "n"}, "s": {"u": "n"}, "a": {"u": "u"}}


def _least(ways: list[str]) -> str:
    """The least of several (cost, audit); no way costs a million or more."""
    return f"list_min([{', '.join(ways)}])"


def _way(cost: str, letter: str, state: str) -> str:
    return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}'}}"


def _oracle() -> str:
    """Forward over the rows: a state's least (cost, audit) behind a row, before turns are put in (n, s, u, a) and after (N, S, U, A)."""
    late = "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)"
    must = "(CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END)"
    keep = lambda i, p: _way(f"{must} + {late} + CASE WHEN r.role[1] = '{i}' THEN 0 ELSE 1000000 END", "K", p)
    change = lambda p: _way(f"{must} + {late} + 3", "R", p)
    after = {
        "n": [_way("4", "D", "p.n2")],
        "s": [_way("4", "D", "p.s2"), keep("s", "p.n2")],
        "u": [_way("4", "D", "p.u2")] + [f(p) for p in ("p.n2", "p.s2", "p.a2") for f in (lambda p: keep("u", p), change)],
        "a": [_way("4", "D", "p.a2"), keep("a", "p.u2"), change("p.u2")],
    }
    put = {
        "n2": "n1",
        "s2": "s1",
        "u2": _least(["u1", _way("3", "I", "n1"), _way("3", "I", "s1"), _way("3", "I", "a1")]),
        "a2": _least(["a1", _way("3", "I", "u1"), _way("6", "II", "n1"), _way("6", "II", "s1")]),
    }
    start, none = ("{'c': " + f"{c}::BIGINT" + ", 't': ''}" for c in (0, 1_000_000))
    first = f"SELECT conv, 0::BIGINT AS i, {', '.join(f'{v} AS {k}1' for k, v in zip('nsua', [start, none, none, none], strict=True))} FROM convs"
    inner = ", ".join(f"{v} AS {k}" for k, v in put.items())
    step = f"SELECT p.conv, p.i + 1, {', '.join(f'{_least(v)} AS {k}1' for k, v in after.items())} FROM (SELECT conv, i, {inner} FROM paths) p JOIN faulty r ON r.conv = p.conv AND r.i = p.i + 1"
    return f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (SELECT k, {_CRC} % 20 AS fault FROM (SELECT DISTINCT k FROM given)),
damaged AS (SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM given JOIN summed USING (k) WHERE fault <> 0),
numbered AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role) OVER w AS earlier, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM numbered),
convs AS (SELECT DISTINCT conv FROM given),
paths AS ({first} UNION ALL {step}),
last AS (SELECT conv, {_least(["n1", "a1", _way("3", "I", "u1"), _way("6", "II", "s1"), _way("3", "I", "u1")])} AS best FROM paths QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
-- each edit with the row it takes: inserted turns take none
edits AS (SELECT conv, e, pos, CASE WHEN e <> 'I' THEN count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY conv ORDER BY pos) END AS i FROM (SELECT conv, unnest(string_split(best.t, '')) AS e, generate_subscripts(string_split(best.t, ''), 1) AS pos FROM last WHERE best.t <> '')),
lines AS (SELECT conv, pos, e, role, text, row_number() OVER (PARTITION BY conv ORDER BY pos) AS nth, first_value(e = 'K' AND role[1] = 's') OVER (PARTITION BY conv ORDER BY pos) AS led FROM edits LEFT JOIN faulty USING (conv, i) WHERE e <> 'D'),
texts AS (SELECT conv, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body FROM lines GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.t AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) g JOIN last USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN texts USING (conv)"""


ORACLE = _oracle()
