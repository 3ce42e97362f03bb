"""Ids of public tokenizers, word by word.

A text is cut where a single space or line end stands between two characters
that are no white space.  The tokenizers here never join what stands on both
sides of such a place: the byte-level one cuts before the white space, the one
with word ends drops it, and no piece of the third has a space behind another
character or a line end at all.
So the ids of a text are those of its words, and each distinct word is encoded
once.  A plain word goes straight to the tokenizer's own merges; anything else
is encoded by the whole tokenizer.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Letters up to this character stand for themselves under every Unicode normal form.
PLAIN = "ɏ"
#: Words of a generation of a cache.
WORDS = 300_000
MARKS = (".", ",", "!", "?", ";", ":")
#: ASCII marks that stand behind letters as one pre-token, however many; an apostrophe may begin a contraction.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 0x100 + k for k, b in enumerate(others)}


#: The stand-in of a space.
SPACE = chr(_byte_letters()[0x20])


def byte_letters(text: str) -> str:
    if text.isascii() and text.isalpha():
        return text
    return text.encode().decode("latin-1").translate(_byte_letters())


def chunks_of(text: str, odd: set[str], known: dict) -> list[str]:
    """CUT.split(text) of a text that begins with a space, faster where every space and line end stands between words.

    known: chunks met before; odd: those of them with more white space at an edge,
    which a cut at every space may give as well.
    """
    if "\0" not in text:
        out = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
        if not any(len(c) < 2 or c[1].isspace() or c[-1].isspace() for c in out if c not in known) and (not odd or odd.isdisjoint(out)):
            return out
    out = CUT.split(text)
    odd.update(c for c in out if c[1].isspace() or c[-1].isspace())
    return out


def piece_bytes(letters: str) -> bytes:
    """The bytes of an entry that is written in stand-ins."""
    back = {v: k for k, v in _byte_letters().items()}
    return bytes(back.get(ord(c), ord(c)) for c in letters)


def plain(word: str) -> bool:
    """Letters alone that no normal form changes, so that one pre-token is sure."""
    return word.isalpha() and (word.isascii() or (max(word) <= PLAIN and "İ" not in word))


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """word -> its ids as little-endian 32-bit numbers, for a tokenizer that lower-cases and drops white space; texts are cut at spaces and line ends.

    Two generations: when this one is full it becomes the old one, and what is
    used again comes back from there.
    """

    def __init__(self, path: str, words: int = WORDS):
        super().__init__()
        self.tokenizer = _load(path)
        self.merges, self.words = self.tokenizer.model, words
        self.old: dict[str, bytes] = {}
        self.packers = [struct.Struct(f"<{n}I") for n in range(40)]
        self.tails: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.old.get(word)) is None:
            # marks behind letters are a pre-token of their own
            stem = word.rstrip(TAIL)
            if not (stem and plain(stem)):
                out = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
            else:
                low = stem.lower()
                out = (self.get(low) or self.old.get(low)) if low != word else None
                if out is None:
                    out = self.packed([t.id for t in self.merges.tokenize(byte_letters(low))])
                    if low != word:
                        self[low] = out
                if len(stem) < len(word):
                    out += self.tail(word[len(stem) :])
        self[word] = out
        return out

    def tail(self, marks: str) -> bytes:
        if (out := self.tails.get(marks)) is None:
            out = self.packed([t.id for t in self.merges.tokenize(marks)])
            if len(self.tails) < self.words:
                self.tails[marks] = out
        return out

    def packed(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)].pack(*ids) if len(ids) < 40 else struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        if len(self) > self.words:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def word_ids(path: str) -> WordIds:
    """One cache a worker process, kept from task to task."""
    return WordIds(path)


class TwoTokenizers:
    """Ids and bytes of the same words in two tokenizers: A byte-level, fed a leading space; B adds one itself."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = _load(path_a)
        self.a.encode_special_tokens = True
        self.merges = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {i: piece_bytes(p) for p, i in self.a.get_vocab(with_added_tokens=False).items()}
        for i, token in self.a.get_added_tokens_decoder().items():
            self.bytes_a.setdefault(i, token.content.encode())
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.length_a, self.length_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, chunks: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids in A of chunks (a space or line end, then text) and in B, and whether both spell the chunk."""
        # B adds a space itself: where the chunk has none it is taken off again
        theirs = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        out = []
        for chunk, b in zip(chunks, theirs, strict=True):
            gap, word = chunk[0], chunk[1:]
            b = b if gap == " " else b[1:]
            stem, mark = (word[:-1], word[-1]) if word[-1:] in MARKS else (word, "")
            if stem and plain(stem):
                head = SPACE + byte_letters(stem) if gap == " " else byte_letters(stem)
                a = [] if gap == " " else [t.id for t in self.merges.tokenize(byte_letters(gap))]
                a += [t.id for t in self.merges.tokenize(head)]
                a += [t.id for t in self.merges.tokenize(mark)] if mark else []
                # letters and a mark: neither changes them
                out.append((a, b, True))
                continue
            a, data = self.a.encode(chunk, add_special_tokens=False).ids, chunk.encode()
            out.append((a, b, b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])))
        return out

    def groups(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """Where the ids are cut, as slices of a and of b that begin and end together; both spell the same bytes and no token is empty."""
        i = x = y = from_a = from_b = 0
        for j, q in enumerate(b, 1):
            y += self.length_b[q]
            while x < y:
                x += self.length_a[a[i]]
                i += 1
            if x == y:
                yield from_a, i, from_b, j
                from_a, from_b = i, j


@cache
def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)
