"""Reading and writing the legacy ARC format and WARC records; plain Python over byte streams.

An ARC file begins with a version block, whose first line names the file and
declares the block's length, whose second gives the version and whose third
lists the header fields.  Every later record is one header line in that
version's fields, the last of which declares the length, then that many bytes
and a line feed.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

#: The header fields of ARC versions 1 and 2.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:srclens:archive")


class Unzipped(io.RawIOBase):
    """The bytes of a gzip file of any number of members, a bounded piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member = data, 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                if self.at >= len(self.data):
                    return 0
                self.member = zlib.decompressobj(31)
            tail = self.member.unconsumed_tail
            feed = tail or self.data[self.at : self.at + (1 << 16)]
            if not tail:
                self.at += len(feed)
            got = self.member.decompress(feed, len(into))
            if got:
                into[: len(got)] = got
                return len(got)
            if not feed:
                return 0


def stream(data: bytes) -> BinaryIO:
    return io.BufferedReader(Unzipped(data), 1 << 17) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def exactly(f: BinaryIO, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"a record declares {n} bytes and has {len(got)}")
    return got


def token(value: str | None) -> str:
    """A header field: white space and controls percent-encoded, '-' for none."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value) if value else "-"


def arc_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 srclens\n{' '.join(FIELDS[version])}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, name: str, url: str | None, date: str, content: bytes, offset: int) -> bytes:
    line = {"URL": token(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content))}
    return " ".join(line[f] for f in FIELDS[version]).encode("utf-8", "surrogateescape") + b"\n" + content


def read_arc(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record; the version block sets the fields and is not given."""
    fields = FIELDS[1]
    while line := f.readline():
        if not line.strip():
            continue
        if line.startswith(b"filedesc://"):
            f_block = exactly(f, int(line.split()[-1])).split(b"\n")
            version = int(f_block[0].split()[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = FIELDS[version]
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} header fields where the version has {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        if head.get("Checksum", "-") == hashlib.md5(content := exactly(f, int(head["Archive-length"]))).hexdigest() or head.get("Checksum", "-") == "-":
            yield head, content
        else:
            raise ValueError("a record's checksum is not that of its bytes")


def http_block(page: str | None, payload: bytes) -> bytes:
    """A page's HTTP response; its id is percent-encoded, and none has no field."""
    own = "" if page is None else f"X-Page-Id: {quote(page, safe='')}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def page_of(fields: dict[str, str]) -> str | None:
    """The id that ``http_block`` wrote."""
    own = fields.get("x-page-id")
    return None if own is None else unquote(own)


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields in lower case, payload."""
    end = block.find(b"\r\n\r\n")
    head = block[: end + 4] if end >= 0 else block
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head, {k.lower(): v for k, v in fields.items()}, block[len(head) :]


def iso(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page} {digest}')}>"


def warc(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record but for its very last line feed."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogateescape") + block + b"\r\n\r"


def read_warc(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record, by declared length; the block's digest is checked."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip().lower()] = v.strip()
        block = exactly(f, int(head["content-length"]))
        if head.get("warc-block-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
            raise ValueError("a block's digest is not that of its bytes")
        yield head, block
