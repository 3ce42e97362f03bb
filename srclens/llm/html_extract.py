"""HTML extraction (operator 3) by wrapper induction.

1. Every page is parsed into blocks and a skeleton of its block elements.  What
   no alignment can tell from an article goes at once: scripts, forms, hidden
   elements, and names that say adverts or reader comments, which vary like it.
   Elements such as nav and footer, and names such as sidebar, are only marked.
2. Of pages with the same text on a host one counts.  Per host and skeleton,
   each node's texts and lengths are aggregated: a few rows a skeleton, however
   many pages a host has.  Texts that stand on one page alone count as a number.
3. All of a host's skeletons are matched into one wrapper (``wrapper``): parts
   of them one after the other by several tasks, then the parts' wrappers.
4. The text of a page is its blocks below the slot of its skeleton that are no
   template.  A page without any block there gives all blocks that are none.
   Marked elements are template like any other where their text stands still;
   only where it varies, or a host has too few pages, their names decide.

Defined results.  Null and empty html give an empty text.  Null urls and urls
without host are one host.  A host with one or two different pages has no
template: their markup alone decides.  Copies of one page show no template
either, and have no more weight than the page.  Repeated
rows and ids get their row each.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, partitions
from .dom import OUT, parse
from .wrapper import SEVERAL, Wrapper, verdict

#: Skeletons that one task matches, and those whose results are handed on together.
PART, BATCH = 1024, 256


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


#: Of a page's blocks: marks is 1 at the first of a text in its node, 3 at the first in the node.
LISTS = {"nodes": pa.int64(), "hashes": pa.int64(), "chars": pa.int64(), "marks": pa.int64(), "named": pa.int64(), "texts": pa.string()}


def parsed(rows: DataFrame) -> DataFrame:
    """rows: (page, url, host, html).  (page, url, host, id, skeleton, content, and the lists of its blocks that may be article).

    The skeleton stands at a host's first page of it in each batch alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple] = set()
            ids, skeletons, contents, lists = [], [], [], {c: [] for c in LISTS}
            for name, source in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                page = parse(source.as_py() or "")
                skeleton = page.skeleton()
                ids.append(digest(skeleton))
                skeletons.append(None if (name, ids[-1]) in seen else skeleton)
                seen.add((name, ids[-1]))
                blocks = [(node, digest(t), t, noise) for node, noise, t in page.blocks if noise < OUT]
                contents.append(digest("\n".join(t for *_, t, noise in blocks if not noise)))
                marks, met = [], set()
                for node, h, *_ in blocks:
                    marks.append(3 if node not in met else int((node, h) not in met))
                    met |= {node, (node, h)}
                for c, values in zip(LISTS, ([x[0] for x in blocks], [x[1] for x in blocks], [0 if x[3] else len(x[2]) for x in blocks], marks, [x[3] for x in blocks], [x[2] for x in blocks]), strict=True):
                    lists[c].append(values)
            own = [pa.array(ids, pa.int64()), pa.array(skeletons, pa.string()), pa.array(contents, pa.int64()), *(pa.array(lists[c], pa.list_(k)) for c, k in LISTS.items())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *own], [*b.schema.names[:3], "id", "skeleton", "content", *LISTS])

    lists = [T.StructField(c, T.ArrayType(T.StringType() if k == pa.string() else T.LongType())) for c, k in LISTS.items()]
    own = [T.StructField("id", T.LongType()), T.StructField("skeleton", T.StringType()), T.StructField("content", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *own, *lists]))


def statistics(pages: DataFrame) -> DataFrame:
    """pages: of ``parsed``.  (host, id, skeleton, weight, nodes): distinct pages, and per node its pages, characters, texts, and (hash, pages) of each text that enough pages of the host have to be template."""
    one = pages.groupBy("host", "content").agg(F.min(F.struct("id", "nodes", "hashes", "chars", "marks")).alias("p")).select("host", "p.*")
    # node -1 counts the pages
    page = F.array(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in (("nodes", -1), ("hashes", 0), ("chars", 0), ("marks", 3)))))
    blocks = one.select("host", "id", F.explode(F.concat(page, F.arrays_zip("nodes", "hashes", "chars", "marks"))).alias("b"))
    blocks = blocks.select("host", "id", F.col("b.nodes").alias("node"), F.col("b.hashes").alias("hash"), F.col("b.chars").alias("chars"), F.col("b.marks").alias("mark"))
    text = blocks.groupBy("host", "id", "node", "hash").agg(F.sum((F.col("mark") > 0).cast("long")).alias("n"), F.sum((F.col("mark") == 3).cast("long")).alias("pages"), F.sum("chars").alias("chars"))
    text = text.withColumn("held", F.sum("n").over(Window.partitionBy("host", "hash")))
    node = text.groupBy("host", "id", "node").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("n").alias("every"), F.collect_list(F.when(F.col("held") >= SEVERAL, F.struct("hash", "n"))).alias("texts"))
    tree = node.groupBy("host", "id").agg(F.max(F.when(F.col("node") < 0, F.col("pages"))).alias("weight"), F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "pages", "chars", "every", "texts"))).alias("nodes"))
    return pages.groupBy("host", "id").agg(F.max("skeleton").alias("skeleton")).join(tree, ["host", "id"], "left")


STATS = "array<struct<node: long, pages: long, chars: long, every: long, texts: array<struct<hash: long, n: long>>>>"
_NODES = pa.list_(pa.struct([("node", pa.int64()), ("pages", pa.int64()), ("chars", pa.int64()), ("every", pa.int64()), ("texts", pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())])))]))
_LONGS, _HASHES = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))


def _stats(nodes) -> dict[int, tuple]:
    return {x["node"]: (x["pages"], x["chars"], x["every"], [(t["hash"], t["n"]) for t in x["texts"]]) for x in nodes.as_py() or []}


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, done) -> Iterator[pa.RecordBatch]:
    """Rows (the keys, id, skeleton, weight, nodes) sorted by keys: what done(keys, wrapper) gives for each wrapper of equal keys."""
    at, wrapper = None, Wrapper()
    for b in batches:
        for row in zip(*b.columns, strict=True):
            key = tuple(v.as_py() for v in row[:keys])
            if key != at and at is not None:
                yield from done(at, wrapper)
                wrapper = Wrapper()
            at = key
            wrapper.add(row[keys].as_py(), row[keys + 1].as_py(), _stats(row[keys + 3]), row[keys + 2].as_py() or 0)
    if at is not None:
        yield from done(at, wrapper)


def _part(key: tuple, wrapper: Wrapper) -> Iterator[pa.RecordBatch]:
    """A part's wrapper (kind 0), and each of its skeletons with the places of its nodes in it (kind 1)."""
    whole, place = wrapper.skeleton()
    nodes = [{"node": k, "pages": n.pages, "chars": n.chars, "every": n.every, "texts": [{"hash": h, "n": c} for h, c in sorted(n.texts.items())]} for k, n in zip(place, wrapper.nodes, strict=True)]
    yield _rows(key, [(0, None, whole, wrapper.weight, nodes, None)])
    for some in batched(wrapper.added(), BATCH):
        yield _rows(key, [(1, name, skeleton, 0, None, [place[i] for i in of]) for name, skeleton, of in some])


def _rows(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), _NODES, _LONGS)
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.string()), pa.array([key[1]] * len(rows), pa.int64()), *cols], ["host", "part", "kind", "id", "skeleton", "weight", "nodes", "of"])


def _whole(key: tuple, wrapper: Wrapper) -> Iterator[pa.RecordBatch]:
    """For each part of a host what the host's wrapper knows of its nodes."""
    known = [n.template() for n in wrapper.nodes]
    own = [n.every > sum(n.texts[h] for h in drop) for n, drop in zip(wrapper.nodes, known, strict=True)]
    for name, _, of in wrapper.added():
        cols = [[wrapper.nodes[i].pages for i in of], [wrapper.nodes[i].chars for i in of], [int(own[i]) for i in of], [known[i] for i in of]]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([name], pa.int64()), *(pa.array([c], k) for c, k in zip(cols, (_LONGS, _LONGS, _LONGS, _HASHES), strict=True))], ["host", "part", "pages", "chars", "own", "known"])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, kind, id, skeleton, of, pages, chars, own, known) by part, what the host knows first: each skeleton's slot and template."""
    held = None
    for b in batches:
        out = []
        for host_, _, kind, name, skeleton, of, *known in zip(*b.columns, strict=True):
            if kind.as_py() == 0:
                held = [x.as_py() for x in known]
                continue
            slot, drop, listed = verdict(skeleton.as_py(), of.as_py(), *held)
            out.append((host_.as_py(), name.as_py(), sorted(slot), [k for k, _ in drop], [h for _, h in drop], listed))
        kinds = (pa.string(), pa.int64(), _LONGS, _LONGS, _LONGS, _LONGS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["host", "id", "slot", "node", "hash", "listed"])


def wrappers(stats: DataFrame, ws: Workspace) -> DataFrame:
    """(host, id, slot, node, hash, listed): the nodes of each host's skeleton in its slot, its template texts, each with its node, and the nodes whose names decide.

    A host's skeletons are dealt to parts of about ``PART``, each matched into
    a wrapper by one task; the parts' wrappers are matched into the host's.
    """
    n = partitions(stats.sparkSession)
    parts = ws.save(stats.groupBy("host").agg(F.ceil(F.count("*") / PART).alias("parts")), "parts")
    dealt = stats.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    ordered = dealt.repartition(n, "host", "part").sortWithinPartitions("host", "part", F.desc_nulls_last("weight"), "id").select("host", "part", "id", "skeleton", "weight", "nodes")
    kinds = f"host string, part long, kind long, id long, skeleton string, weight long, nodes {STATS}, of array<long>"
    first = ws.save(ordered.mapInArrow(lambda batches: _grouped(batches, 2, _part), kinds), "part-wrappers")
    of_host = first.where("kind = 0").select("host", F.col("part").alias("id"), "skeleton", "weight", "nodes")
    of_host = of_host.repartition(n, "host").sortWithinPartitions("host", F.desc("weight"), "id")
    known = of_host.mapInArrow(lambda batches: _grouped(batches, 1, _whole), "host string, part long, pages array<long>, chars array<long>, own array<long>, known array<array<long>>")
    known = ws.save(known, "host-wrappers")
    null = lambda *names: [F.lit(None).cast(k).alias(c) for c, k in names]
    lists = [("pages", "array<long>"), ("chars", "array<long>"), ("own", "array<long>"), ("known", "array<array<long>>")]
    asks = first.where("kind = 1").select("host", "part", "kind", "id", "skeleton", "of", *null(*lists))
    tells = known.select("host", "part", F.lit(0).cast("long").alias("kind"), *null(("id", "long"), ("skeleton", "string"), ("of", "array<long>")), "pages", "chars", "own", "known")
    both = tells.unionByName(asks).repartition(n, "host", "part").sortWithinPartitions("host", "part", "kind", "id")
    return both.mapInArrow(_verdicts, "host string, id long, slot array<long>, node array<long>, hash array<long>, listed array<long>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, text): one row a row of pages."""
    ws = Workspace(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    known = ws.save(parsed(rows), "parsed")
    table = ws.save(wrappers(statistics(known), ws), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for nodes, hashes, named, texts, slot, node, drop, listed in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                inside, template, listed = set(slot or ()), set(zip(node or (), drop or (), strict=True)), set(listed or ())
                if inside.isdisjoint(k for k, n in zip(nodes, named, strict=True) if not n):
                    inside = set(nodes)
                kept = (t for k, h, n, t in zip(nodes, hashes, named, texts, strict=True) if k in inside and (k, h) not in template and not (n and k in listed))
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page", "url", "text"])

    joined = known.join(table, ["host", "id"], "left").select("page", "url", "nodes", "hashes", "named", "texts", "slot", "node", "hash", "listed")
    kinds = [T.StructField("page", rows.schema["page"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]
    return joined.mapInArrow(read, T.StructType(kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("page").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
