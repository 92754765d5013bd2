"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies f = target / source size. The
running sum of f over the source's documents, plus one random offset, is cut at the integers: a
document is emitted once for each integer boundary that its step crosses. The offset follows from
`seed` and the source, so reruns agree.

Order: within a source by size class (so the words taken follow the target closely), then by a hash of
id and text. A source and class with many rows is cut into ranges of that hash, as many as its count
asks for (about `PART_ROWS` rows each); the order number is the sum of the ranges before and a rank
inside the range, so no source, size or run of ids is gathered in one task. Sources and their ranges
themselves are summed in windows: a few numbers a source must fit a task, a range a (source, class).

Nulls: a null text has size 0; a null source is a source of its own, ordered last. A null doc_id
counts as one id of its own. Repeated rows are separate documents: of copies of one id and text the
shares are dealt as evenly as can be. Ids may be of any type. Very long texts are taken whole. An empty
table gives no rows; further columns, whatever their names, come back as they were. Sources of size 0 have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, store, text_of

WEIGHTS = (3, 1, 2)
PART_ROWS = 65_536


def source_targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """Rows (source, source_size, target): weights go round the sources in code-point order.

    Filling in order of cap / weight is the same as resharing the excess by weight until no source
    is above its cap: a source is capped if the level of the rest would exceed its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.when(turn % 3 == 0, WEIGHTS[0]).when(turn % 3 == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    per = per.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("all_size", F.sum("source_size").over(whole))
    per = per.withColumn("level", (F.col("all_size") * share - F.col("before")) / F.col("w_left"))
    open_ = F.col("level") * F.col("w") < F.col("most")
    # The first source in this order that is not capped sets the level for itself and all after it.
    per = per.withColumn("place", F.row_number().over(order)).withColumn("final", F.min(F.when(open_, F.struct("place", "level"))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("w")))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _digits(text) -> F.Column:
    """32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _offset(source, seed: str):
    return _digits(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000null")))).cast("double") / F.lit(4294967296.0)


def _row_digest(docs: DataFrame) -> F.Column:
    """Digest of a row's id and text."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.lit(":"), text_of(docs)))


def _size_class(size):
    """Sizes up to 1023 are classes of their own; larger ones keep three leading digits."""
    step = F.pow(F.lit(10.0), F.greatest(F.length(size.cast("string")) - 3, F.lit(0))).cast("long")
    return F.when(size < 1024, size).otherwise(F.floor(size / step) * step)


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    return _planned(docs, share, cap, seed).drop("digest")


def _planned(docs: DataFrame, share: float, cap: float, seed: str) -> DataFrame:
    digest = _row_digest(docs)
    sizes = docs.select("doc_id", "source", F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("at"))
    sizes = sizes.withColumn("class", _size_class(F.col("size")))
    sizes = store(sizes.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-sizes")
    targets = source_targets(sizes.select("source", "size"), share, cap).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = sizes.groupBy("src", "class").agg(F.count("*").alias("n"))
    classes = classes.select("src", "class", F.ceil(F.col("n") / PART_ROWS).alias("parts"), earlier(Window.partitionBy("src").orderBy("class")).alias("class_start"))
    classes = store(classes, "mix-classes")
    parted = sizes.join(classes, ["src", "class"]).withColumn("part", F.floor(F.col("at") * F.col("parts") / F.lit(2**32)))
    blocks = parted.groupBy("src", "class", "part").agg(F.count("*").alias("n"), F.first("class_start").alias("class_start"))
    blocks = blocks.withColumn("start", F.col("class_start") + earlier(Window.partitionBy("src", "class").orderBy("part"))).drop("class_start")
    blocks = blocks.join(store(targets.drop("source"), "mix-targets"), "src").drop("n")
    blocks = blocks.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    # Rows with one digest are copies of one id and text: any order among them gives the same rows.
    rank = F.row_number().over(Window.partitionBy("src", "class", "part").orderBy("digest"))
    out = parted.drop("parts", "class_start").withColumn("rank", rank).join(blocks, ["src", "class", "part"]).withColumn("u", _offset(F.col("source"), seed))
    at = F.col("start") + F.col("rank")
    copies = F.floor(F.col("u") + F.col("f") * at) - F.floor(F.col("u") + F.col("f") * (at - 1))
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "digest")


def emit_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed documents themselves: every row as often as its copies say, with the input's columns.

    A row travels as one struct, so that no column of its own can meet one of the plan's.
    """
    plan = _planned(docs, share, cap, seed).groupBy("digest").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = store(plan.where("copies > 0"), "mix-plan")
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row")
    j = docs.select(_row_digest(docs).alias("digest"), row).join(plan, "digest")
    once = j.where("rows = 1").select("row", F.col("copies").alias("times"))
    if not plan.where("rows > 1").isEmpty():
        # Rows that repeat id and text share their copies; which of them comes first does not show, as only their other columns could differ.
        others = F.xxhash64(F.to_json(F.col("row").dropFields("text"))) if len(docs.columns) > 1 else F.lit(0)
        more = j.where("rows > 1").withColumn("turn", F.row_number().over(Window.partitionBy("digest").orderBy(others)))
        once = once.unionByName(more.select("row", (F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("int")).alias("times")))
    each = once.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS digest FROM documents),
c AS (SELECT *, CASE WHEN size < 1024 THEN size ELSE (size // (10 ** greatest(len(size::VARCHAR) - 3, 0))::BIGINT) * (10 ** greatest(len(size::VARCHAR) - 3, 0))::BIGINT END AS class FROM d),
p AS (SELECT source, sum(size)::DOUBLE AS source_size, (sum(size) * 2.0)::DOUBLE AS most, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, (CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM p),
o AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "before",
  sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(source_size) OVER () AS all_size FROM w),
l AS (SELECT *, (all_size * 1.5::DOUBLE - "before") / w_left AS level, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS place FROM o),
f AS (SELECT *, (SELECT x.level FROM l AS x WHERE x.level * x.w < x.most ORDER BY x.place LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN most ELSE least(most, final * w) END AS target,
  ('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, digest) AS pos FROM c),
j AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.u, r.pos, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0::DOUBLE END AS f
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, ((floor(u + f * pos) - floor(u + f * (pos - 1)))::BIGINT * size) AS taken,
  (floor(u + f * pos) - floor(u + f * (pos - 1)))::BIGINT AS copies FROM j
"""
