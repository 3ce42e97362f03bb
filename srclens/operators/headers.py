"""File headers: recognised, built, inserted and updated as Column functions; who writes them, and when.

A header is eleven lines of 80 ASCII bytes.  A field that does not fit refuses
the header; nothing is cut.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each kind of file what frames a line, its edge, the lead of a field and the right ends of lines 2 to 10.
KINDS = {
    "c": ("/*", "*/", "/* ************************************************************************** */", "   ", ["", ":::      ::::::::   ", ":+:      :+:    :+:   ", "+:+ +:+         +:+     ", "+#+  +:+       +#+        ", "+#+#+#+#+#+   +#+           ", "#+#    #+#             ", "###   ########.fr       ", ""]),
    "makefile": ("#", "#", "# **************************************************************************** #", "    ", ["", ":::      ::::::::    ", ":+:      :+:    :+:    ", "+:+ +:+         +:+      ", "+#+  +:+       +#+         ", " +#+#+#+#+#+   +#+            ", "#+#    #+#              ", "###   ########.fr        ", ""]),
}
WIDTH, LINES = 80, 11
#: The shape of an accepted address, and of a time stamp.
EMAIL = r"(?i)^([A-Za-z0-9][A-Za-z0-9._-]*)@(42\.fr|student\.42[A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)+)$"
STAMP = "%Y/%m/%d %H:%M:%S"


def clock(epoch: str | None, now: datetime | None = None) -> str:
    """One time stamp for a run: that of SOURCE_DATE_EPOCH if it is given, in UTC; a value that is no number of seconds is an error."""
    if epoch is None:
        return (now or datetime.now()).strftime(STAMP)
    if not re.fullmatch(r"[+-]?\d+", epoch):
        raise ValueError("SOURCE_DATE_EPOCH is no number of seconds")
    return datetime.fromtimestamp(int(epoch), UTC).strftime(STAMP)


def stamp(epoch: Column) -> Column:
    """``clock`` by column: the time stamp of a number of seconds, in UTC whatever the session's zone; null of anything else."""
    at = F.to_utc_timestamp(F.timestamp_seconds(epoch.try_cast("long")), F.current_timezone())
    return F.when(epoch.rlike(r"^[+-]?\d+$"), F.date_format(at, "yyyy/MM/dd HH:mm:ss"))


def email(value: Column) -> Column:
    """The address in lower case, null if it is not accepted."""
    clean = F.trim(value)
    return F.when(clean.rlike(EMAIL), F.lower(clean))


def identity(candidates: DataFrame) -> DataFrame:
    """candidates (who, priority, email, login): for each who the login and address of the first candidate that names an address.

    A first candidate that is not accepted, or whose login is not that of its
    address, gives its problem; later ones don't take its place.
    """
    given = candidates.where(F.trim(F.coalesce("email", F.lit(""))) != "")
    first = given.groupBy("who").agg(F.min_by(F.struct("email", "login"), "priority").alias("c"))
    address = email(F.col("c.email"))
    own = F.substring_index(address, "@", 1)
    problem = F.when(address.isNull(), "IDENTITY_INVALID_EMAIL").when(F.lower("c.login") != own, "IDENTITY_LOGIN_MISMATCH")
    out = first.select("who", address.alias("address"), own.alias("name"), problem.alias("problem"))
    everyone = candidates.select("who").distinct().join(out, "who", "left")
    missing = F.when(F.col("problem").isNull() & F.col("address").isNull(), "IDENTITY_UNAVAILABLE").otherwise(F.col("problem"))
    return everyone.select("who", F.when(F.col("problem").isNull(), F.col("name")).alias("login"), F.when(F.col("problem").isNull(), F.col("address")).alias("email"), missing.alias("problem"))


def _fields(kind: str, name: Column, login: Column, address: Column, created: Column, updated: Column, creator: Column) -> list[Column]:
    lead = F.lit(KINDS[kind][3])
    blank = F.lit("")
    return [
        blank,
        blank,
        F.concat(lead, name),
        blank,
        F.concat(lead, F.lit("By: "), login, F.lit(" <"), address, F.lit(">")),
        blank,
        F.concat(lead, F.lit("Created: "), created, F.lit(" by "), creator),
        F.concat(lead, F.lit("Updated: "), updated, F.lit(" by "), login),
        blank,
    ]


def _room(kind: str, right: str) -> int:
    return WIDTH - len(KINDS[kind][0]) - len(KINDS[kind][1]) - len(right)


def _line(kind: str, left: Column, right: str) -> Column:
    """A framed line; null where left is not ASCII or does not fit."""
    room = _room(kind, right)
    fits = (F.octet_length(left) == F.char_length(left)) & (F.octet_length(left) <= room)
    return F.when(fits, F.concat(F.lit(KINDS[kind][0]), left, F.repeat(F.lit(" "), room - F.octet_length(left)), F.lit(right + KINDS[kind][1])))


def build(kind: str, name: Column, login: Column, address: Column, created: Column, updated: Column | None = None, creator: Column | None = None) -> Column:
    """The header, null if a field does not fit; it ends without a line feed."""
    edge = F.lit(KINDS[kind][2])
    fields = _fields(kind, name, login, address, created, created if updated is None else updated, login if creator is None else creator)
    rows = [_line(kind, left, right) for left, right in zip(fields, KINDS[kind][4], strict=True)]
    return F.concat(edge, *(x for row in rows for x in (F.lit("\n"), row)), F.lit("\n"), edge)


def lines_of(content: Column) -> Column:
    return F.transform(F.split(content, "\n", LINES + 1), lambda x: F.regexp_replace(x, "\r$", ""))


def _pattern(kind: str, k: int) -> str:
    left, right, _, lead, ends = KINDS[kind]
    stamp = r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} by [^ ]+"
    body = {2: lead + r"[^ /][^/]*?", 4: lead + r"By: [^ ]+ <[^ >]+>", 6: f"{lead}Created: {stamp}", 7: f"{lead}Updated: {stamp}"}.get(k, "")
    return f"^{re.escape(left)}{body} *{re.escape(ends[k] + right)}$"


def is_valid(kind: str, content: Column) -> Column:
    """Whether a text begins with a header of this kind."""
    rows = lines_of(content)
    ok = (F.size(rows) > LINES - 1) & (F.get(rows, F.lit(0)) == KINDS[kind][2]) & (F.get(rows, F.lit(LINES - 1)) == KINDS[kind][2])
    for k in range(LINES - 2):
        row = F.get(rows, F.lit(k + 1))
        ok = ok & row.rlike(_pattern(kind, k)) & (F.octet_length(row) == WIDTH)
    return F.coalesce(ok, F.lit(False))


def ensure(kind: str, content: Column, name: Column, login: Column, address: Column, stamp: Column) -> Column:
    """struct(content, status): the text with a header before it; status is valid, inserted, unavailable (nobody to name) or too_long."""
    head = build(kind, name, login, address, stamp)
    status = F.when(is_valid(kind, content), "valid").when(login.isNull() | address.isNull(), "unavailable").when(head.isNull(), "too_long").otherwise("inserted")
    return F.struct(F.when(status == "inserted", F.concat(head, F.lit("\n\n"), content)).otherwise(content).alias("content"), status.alias("status"))


def update(kind: str, content: Column, name: Column, login: Column, stamp: Column) -> Column:
    """A text with a valid header whose name and last update are made anew; any other text stays, and so does one whose fields don't fit."""
    rows = F.split(content, "\n", LINES + 1)
    fields = _fields(kind, name, login, F.lit(""), stamp, stamp, login)
    new = {3: _line(kind, fields[2], KINDS[kind][4][2]), 8: _line(kind, fields[7], KINDS[kind][4][7])}
    fits = new[3].isNotNull() & new[8].isNotNull()
    placed = F.transform(rows, lambda x, i: F.when(i == 3, new[3]).when(i == 8, new[8]).otherwise(x))
    return F.when(is_valid(kind, content) & F.coalesce(fits, F.lit(False)), F.array_join(placed, "\n")).otherwise(content)


def diagnostics(files: DataFrame, kind: str) -> DataFrame:
    """files (path, content): those without a valid header, as diagnostics."""
    return files.where(~is_valid(kind, F.col("content"))).select("path", F.lit(1).alias("line"), F.lit("error").alias("severity"), F.lit("INVALID_HEADER").alias("rule_id"), F.lit("missing or malformed").alias("message"))
