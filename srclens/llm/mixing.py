"""Mixing sources to target weights (operator 4) by hierarchical budgets.

A tree of domains, languages and sources is given weights.  The token budget
goes down the tree; a node never gets more than its leaves can give, which is
their tokens times ``epochs``.  What a full node cannot take goes to its
siblings in proportion to their weights, and only what a whole subtree cannot
take goes to the siblings of its ancestor.  That is a water level per parent:
siblings in order of capacity by weight, running sums, no iteration.

A leaf with an allotment of more than its tokens gives whole epochs, then a
prefix of the next: documents in the order of a hash of seed, epoch and id, as
long as their tokens fit.  Prefix sums run over hash buckets first; only the one
bucket that holds the border is ordered row by row, so no leaf meets in one
task; what does meet in one is a leaf's sums of buckets, 65,536 at most.

All arithmetic is on integers.  Defined results.  Null text has no tokens; null
language or source is ''.  Weights under 1 take nothing, unnamed nodes weigh 1.
Rows that repeat an id are taken one by one; null ids sort as ''.  An empty
table gives an empty result.  Columns that clash with the result's are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

LEVELS = ["domain", "lang", "source"]
#: Hex digits of the hash that make a bucket.
BUCKET = 4
BIG = "decimal(19,0)"
Weights = dict[tuple[str, ...], int]

#: The production mix: domains of sources, and weights by path in the tree.
DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web' WHEN source IN ('src8', 'src9', 'src10', 'src11', 'src12') THEN 'books' ELSE 'other' END"
WEIGHTS: Weights = {("web",): 5, ("books",): 3, ("other",): 2} | {(d, lang): w for d in ("web", "books", "other") for lang, w in (("en", 6), ("de", 2))}
SHARE, EPOCHS, SEED = (1, 2), 2, "mix-1"


def tokens(text):
    """Runs of characters that are not ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, budget: int | None, weights: Weights, epochs: int, share: tuple[int, int] = SHARE) -> DataFrame:
    """leaves: (domain, lang, source, tokens).  Adds ``allotment``.  budget None: a share of all tokens."""
    spark = leaves.sparkSession
    table = [(*(p + (None,) * (3 - len(p))), w) for p, w in weights.items()]
    given = spark.createDataFrame(table, "domain string, lang string, source string, weight long")
    out = leaves.withColumn("root", F.lit(0))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * share[0] // share[1] if budget is None else budget
    out = out.withColumn("allot0", F.lit(total).cast(BIG))
    for k in range(1, 4):
        path, parent = LEVELS[:k], ["root", *LEVELS[: k - 1]]
        of = given.where(" and ".join([f"{c} is not null" for c in path] + [f"{c} is null" for c in LEVELS[k:]])).select(*path, "weight")
        nodes = out.groupBy(*parent, LEVELS[k - 1], f"allot{k - 1}").agg((F.sum("tokens") * epochs).cast(BIG).alias("cap")).join(F.broadcast(of), path, "left")
        nodes = nodes.withColumn("w", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(0)).cast(BIG)).where("w > 0").drop("weight")
        order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), LEVELS[k - 1])
        before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
        total_ = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast(BIG)
        nodes = nodes.withColumns({"cap_before": total_("cap", before), "w_before": total_("w", before), "w_all": total_("w", whole)})
        nodes = nodes.withColumn("full", F.expr(f"cap * (w_all - w_before) <= w * (allot{k - 1} - cap_before)"))
        nodes = nodes.withColumns({"cap_full": total_(F.when(F.col("full"), F.col("cap")), whole), "w_full": total_(F.when(F.col("full"), F.col("w")), whole)})
        got = F.expr(f"CASE WHEN full THEN cap ELSE cast((w * (allot{k - 1} - cap_full)) div (w_all - w_full) AS {BIG}) END")
        nodes = nodes.select("root", *path, got.alias(f"allot{k}"))
        out = out.join(nodes, ["root", *path])
    return out.select(*LEVELS, "tokens", F.col("allot3").cast("long").alias("allotment"))


def mix(docs: DataFrame, domain: str = DOMAIN, weights: Weights | None = None, budget: int | None = None, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, domain, lang, source, n_tokens, epochs): the documents taken once at least, and how often."""
    ws = Workspace(docs.sparkSession, "mixing")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.expr(domain), F.lit("")).alias("domain"), text("lang"), text("source"), tokens(F.col(text_col)).alias("n_tokens"))
    rows = ws.save(rows, "rows")
    leaves = ws.save(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    leaf = ws.save(budgets(leaves, budget, WEIGHTS if weights is None else weights, epochs, share), "budgets")
    leaf = leaf.select(*LEVELS, F.expr("CASE WHEN tokens > 0 THEN allotment div tokens ELSE 0 END").cast("long").alias("whole"), F.expr("CASE WHEN tokens > 0 THEN allotment % tokens ELSE 0 END").alias("rest"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.join(leaf, LEVELS).withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET))
    sums = dealt.where("rest > 0").groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = ws.save(sums.select(*LEVELS, "bucket", (upto - F.col("sum")).alias("before"), upto.alias("after")), "buckets")
    dealt = dealt.join(sums, [*LEVELS, "bucket"], "left")
    inside = F.coalesce(F.col("after") <= F.col("rest"), F.lit(False))
    border = (F.col("before") <= F.col("rest")) & (F.col("after") > F.col("rest"))
    row = Window.partitionBy(*LEVELS, "bucket").orderBy("order", "doc", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    at = dealt.where(border).withColumn("cum", F.col("before") + F.sum("n_tokens").over(row)).withColumn("more", (F.col("cum") <= F.col("rest")).cast("int")).drop("cum")
    rest = dealt.where(~F.coalesce(border, F.lit(False))).withColumn("more", inside.cast("int"))
    out = at.unionByName(rest).withColumn("epochs", F.col("whole") + F.col("more"))
    return out.where("epochs > 0").select("doc", *LEVELS, "n_tokens", F.col("epochs").cast("long").alias("epochs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("doc", "doc_id")


def _level(k: int) -> str:
    path, parent = ", ".join(LEVELS[:k]), ", ".join(["root", *LEVELS[: k - 1]])
    weight = "CASE " + " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(LEVELS, p, strict=False))} THEN {w}" for p, w in WEIGHTS.items() if len(p) == k) + " ELSE 1 END" if any(len(p) == k for p in WEIGHTS) else "1"
    return f"""
  n{k} AS (SELECT {parent}, {LEVELS[k - 1]}, allot{k - 1}, sum(tokens)::HUGEINT * {EPOCHS} AS cap, ({weight})::HUGEINT AS w FROM b{k - 1} GROUP BY ALL),
  o{k} AS (SELECT *, coalesce(sum(cap) OVER p, 0)::HUGEINT AS cap_before, coalesce(sum(w) OVER p, 0)::HUGEINT AS w_before, (sum(w) OVER (PARTITION BY {parent}))::HUGEINT AS w_all
    FROM n{k} WINDOW p AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {LEVELS[k - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f{k} AS (SELECT *, cap * (w_all - w_before) <= w * (allot{k - 1} - cap_before) AS is_full FROM o{k}),
  g{k} AS (SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER q, 0)::HUGEINT AS cap_full, coalesce(sum(w) FILTER (WHERE is_full) OVER q, 0)::HUGEINT AS w_full FROM f{k} WINDOW q AS (PARTITION BY {parent})),
  b{k} AS (SELECT b.*, CASE WHEN is_full THEN cap ELSE (w * (g.allot{k - 1} - cap_full)) // (w_all - w_full) END AS allot{k} FROM b{k - 1} b JOIN g{k} g USING (root, {path})),"""


ORACLE = rf"""
WITH r AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
  leaves AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM r GROUP BY ALL),
  b0 AS (SELECT *, ((SELECT sum(tokens) FROM leaves) * {SHARE[0]} // {SHARE[1]})::HUGEINT AS allot0 FROM leaves),{"".join(_level(k) for k in (1, 2, 3))}
  leaf AS (SELECT domain, lang, source, (allot3 // greatest(tokens, 1))::BIGINT AS whole, (allot3 % greatest(tokens, 1))::BIGINT AS rest FROM b3),
  dealt AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM r JOIN leaf USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole + (cum <= rest AND rest > 0)::BIGINT AS epochs FROM dealt WHERE whole + (cum <= rest AND rest > 0)::BIGINT > 0
"""
