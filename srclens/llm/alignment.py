"""Cross-tokenizer alignment (operator 12) by a dictionary of groups.

Both tokenizers spell the same bytes (a space, then the text).  Byte offsets
where tokens of both end cut the ids into groups; no token is empty, so the last
tokens of a group are its one link.  A task interns the groups of its texts in a
block's dictionary and keeps of each document the group numbers with their
frequencies.  The blocks' dictionaries meet by group key: each distinct group is
expanded into its link once, times its frequency, which gives the counts of id
pairs and the highest of each B id.  These go back to the blocks by group key,
and each block values its own documents.  A group that every document holds is
one row a block.

Defined results.  A null or empty text has no tokens, nor has one whose bytes
either tokenizer does not give back: its numbers are 0 and ``groups`` is empty.
Strings of special tokens are plain text.  Repeated rows are rows of their own
and count in full.  Texts may be of any length: a block ends behind the document
that fills it.  An empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .vocabulary import chunks_of, two_tokenizers

#: A block's dictionary holds about so many words and groups, its documents about so many bytes; it ends behind a document.
BLOCK_WORDS, BLOCK_BYTES = 500_000, 1 << 26


class Block:
    """The groups of some documents, numbered as they turn up."""

    def __init__(self, tokenizers, digest):
        self.tokenizers, self.digest = tokenizers, digest
        self.numbers: dict[int | tuple, int] = {}
        self.keys: list[str] = []
        self.last: list[tuple[int, int]] = []
        self.words: dict[str, tuple | None] = {}
        self.odd: set[str] = set()
        self.bytes = 0

    def intern(self, a: list[int], b: list[int]) -> tuple[int, int, list[int], str]:
        own, numbers = [], self.numbers
        for a0, a1, b0, b1 in self.tokenizers.groups(a, b):
            # most groups are one token and one: a number is a shorter name than two tuples
            name = a[a0] << 32 | b[b0] if a1 - a0 == 1 == b1 - b0 else (*a[a0:a1], -1, *b[b0:b1])
            number = numbers.get(name)
            if number is None:
                number = numbers[name] = len(self.last)
                self.keys.append(",".join(map(str, a[a0:a1])) + "|" + ",".join(map(str, b[b0:b1])))
                self.last.append((a[a1 - 1], b[b1 - 1]))
            own.append(number)
        return len(a), len(b), own, ";".join([self.keys[n] for n in own])

    def document(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, digest, group numbers, how often each)."""
        chunks, words = chunks_of(" " + text, self.odd, self.words) if text else [], self.words
        if new := [c for c in dict.fromkeys(chunks) if c not in words]:
            for chunk, (a, b, same) in zip(new, self.tokenizers.ids(new), strict=True):
                words[chunk] = self.intern(a, b) if same else None
        found = [words[c] for c in chunks]
        if None in found:  # spelled otherwise: the whole text decides
            a, b, same = self.tokenizers.ids([" " + text])[0]
            found = [self.intern(a, b)] if same else []
        if not found:
            return 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
        own = np.array(list(chain.from_iterable([f[2] for f in found])), np.int32)
        uses, times = np.unique(own, return_counts=True)
        self.bytes += len(text)
        return sum(f[0] for f in found), sum(f[1] for f in found), len(own), self.digest(";".join([f[3] for f in found])), uses, times.astype(np.int32)

    @property
    def full(self) -> bool:
        return len(self.words) > BLOCK_WORDS or len(self.last) > BLOCK_WORDS or self.bytes > BLOCK_BYTES


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def interned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, digest) -> DataFrame:
    """Rows of two kinds by block: documents (doc, counts, uses, times) and, behind a block's documents, its groups (number, key, a, b, n)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, freq = None, TaskContext.get().partitionId() << 32, np.zeros(0, np.int64)

        def rows(doc_type, made=None, docs=()):
            """A batch of documents, or of a block's groups."""
            none = lambda n, t: pa.nulls(n, t)
            if made is None:
                n, cut = len(docs), list(zip(*docs, strict=True))
                own = [pa.array(cut[0], doc_type), *(pa.array(c, pa.int64()) for c in cut[1:4]), pa.array(cut[4], pa.string()), *(pa.array(c, pa.list_(pa.int32())) for c in cut[5:7])]
                theirs = [none(n, pa.int32()), none(n, pa.string()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64())]
            else:
                n = len(made.last)
                own = [none(n, doc_type), *(none(n, pa.int64()) for _ in range(3)), none(n, pa.string()), *(none(n, pa.list_(pa.int32())) for _ in range(2))]
                last = np.array(made.last, np.int32).reshape(-1, 2)
                theirs = [pa.array(np.arange(n, dtype=np.int32)), pa.array(made.keys), pa.array(last[:, 0]), pa.array(last[:, 1]), pa.array(freq[:n])]
            names = ["doc", "n_a", "n_b", "n_groups", "digest", "uses", "times", "number", "key", "a", "b", "n", "block", "is_group"]
            return pa.RecordBatch.from_arrays([*own, *theirs, pa.array(np.full(n, number)), pa.array(np.full(n, made is not None))], names)

        doc_type, ready = None, []
        for batch in batches:
            doc_type = batch.column(0).type
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if block is None:
                    block, freq = Block(two_tokenizers(path_a, path_b), digest), np.zeros(1 << 12, np.int64)
                got = block.document(texts[i].as_py())
                if len(freq) < len(block.last):
                    freq = np.concatenate([freq, np.zeros(len(block.last) + len(freq), np.int64)])
                freq[got[4]] += got[5]
                ready.append((doc, *got))
                if len(ready) >= 256:
                    yield rows(doc_type, docs=ready)
                    ready = []
                if block.full:
                    if ready:
                        yield rows(doc_type, docs=ready)
                    yield rows(doc_type, block)
                    block, ready, number = None, [], number + 1
        if ready:
            yield rows(doc_type, docs=ready)
        if block is not None and block.last:
            yield rows(doc_type, block)

    schema = f"doc {kind}, n_a long, n_b long, n_groups long, digest string, uses array<int>, times array<int>, number int, key string, a int, b int, n long, block long, is_group boolean"
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _valued(docs: pa.Table, groups: pa.Table) -> pa.Table:
    """The documents of a block with the sums of their links; groups: (number, count, best)."""
    size = len(groups)
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = groups["number"].to_numpy()
    count[at], best[at] = groups["count"].to_numpy(), groups["best"].to_numpy(zero_copy_only=False)
    lists, times = docs["uses"].combine_chunks(), docs["times"].combine_chunks()
    uses, times = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
    out = docs.select(["doc", "n_a", "n_b", "n_groups", "digest"])
    return out.append_column("n_links", docs["n_groups"]).append_column("n_best", pa.array(total(best[uses] * times))).append_column("count_sum", pa.array(total(count[uses] * times)))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest=_digest) -> DataFrame:
    """(doc, n_a, n_b, n_groups, digest, n_links, n_best, count_sum): one row a row of docs.

    digest: what is said of a document's groups ``a1,a2|b1;a3|b2,b3``; the identity returns them.
    """
    ws = Workspace(docs.sparkSession, "alignment")
    made = ws.save(interned(docs, path_a, path_b, id_col, text_col, digest), "interned")
    groups = made.where("is_group").select("block", "number", "key", "a", "b", "n")
    dictionary = ws.save(groups.groupBy("key", "a", "b").agg(F.sum("n").alias("n")), "dictionary")
    pairs = dictionary.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    known = pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    values = dictionary.select("key", "a", "b").join(known, ["a", "b"]).select("key", "count", "best")
    scored = groups.select("block", "number", "key").join(values, "key").select(F.col("block").alias("home"), "number", "count", "best")
    own = made.where("not is_group").select("block", "doc", "n_a", "n_b", "n_groups", "digest", "uses", "times")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_a long, n_b long, n_groups long, digest string, n_links long, n_best long, count_sum long"
    return own.groupBy("block").cogroup(scored.groupBy("home")).applyInArrow(_valued, schema)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())
    return out.select(F.col("doc").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
