"""Chat formatting: cumulative snapshots are collapsed before rendering.

Logged conversations often repeat: each snapshot holds the turns so far. Every turn prefix gets a
rolling hash (a sum of hashes of place, role and text, so it can be summed block by block), equal
conversations become one class, and anti-joins on (turns, prefix hash) keep the classes that are no
proper prefix of a longer one. Kept conversations are rendered with role marks.

Order: by turn, then role, then text (null first); the place in this order counts, not the number.
A conversation with very many turns is ranked and summed in blocks of 256 turn numbers, so no task
needs all its rows before they are rendered into their one string.

Nulls: a null role or text counts as empty; a null turn comes first; rows with a null conv_id are one
conversation of their own, apart from one whose id is the text "null". Of equal conversations the least
conv_id is kept. Repeated rows are turns of their own: each takes a place. Very long texts are taken
whole. Only conv_id, turn, role and text are read; further columns, whatever their names, do no harm.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import sized, store

BLOCK = 256
HASHES = ("h1", "h2", "h3")


def conversation(conv_id):
    """A name for each conversation that no null shares with a real id."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ranked(turns: DataFrame) -> DataFrame:
    """Stored turns (conv, conv_id, block, rank, role, text, c1, c2): each with its rank in its block and two hashes of role and text.

    The one shuffle of all texts; what follows goes by ranks and hashes.
    """
    conv = conversation(F.col("conv_id")).alias("conv")
    t = turns.select(conv, "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    both = [F.xxhash64(F.lit(f"{c}:"), "role", "text").alias(c) for c in ("c1", "c2")]
    return store(t.withColumn("rank", F.row_number().over(inside)).select("conv", "conv_id", "block", "rank", "role", "text", *both), "chat-turns")


def prefixes(t: DataFrame) -> DataFrame:
    """Rows (conv, conv_id, place, s1..s3): each ranked turn with the hashes of the turns up to it."""
    slim = t.select("conv", "conv_id", "block", "rank", "c1", "c2")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = slim.groupBy("conv", "block").agg(F.count("*").alias("n")).select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    p = slim.join(counts, ["conv", "block"]).withColumn("place", (F.col("start") + F.col("rank")).cast("long"))
    for seed, h in enumerate(HASHES):
        p = p.withColumn(h, F.pmod(F.xxhash64(F.lit(seed), "place", "c1", "c2"), F.lit(2**40)))
    p = store(p.select("conv", "conv_id", "block", "place", *HASHES), "chat-places")
    sums = p.groupBy("conv", "block").agg(*[F.sum(h).alias("b" + h) for h in HASHES])
    sums = sums.select("conv", "block", *[F.coalesce(F.sum("b" + h).over(before), F.lit(0)).alias("b" + h) for h in HASHES])
    within = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = p.select("conv", "conv_id", "block", "place", *[F.sum(h).over(within).alias(h) for h in HASHES]).join(sums, ["conv", "block"])
    return out.select("conv", "conv_id", "place", *[(F.col(h) + F.col("b" + h)).alias(h.replace("h", "s")) for h in HASHES])


def render(role, text):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, kept, keep_id, rendered (null unless kept), rendered_sha256.

    keep_id: the least conv_id among the kept conversations that begin with this one, itself if kept.
    """
    texts = ranked(turns)
    t = store(prefixes(texts), "chat-prefixes")
    key = ["place", "s1", "s2", "s3"]
    ends = t.groupBy("conv").agg(F.max("place").alias("place"), F.max_by(F.struct("conv_id", "s1", "s2", "s3"), "place").alias("x"))
    ends = store(ends.select("conv", "place", "x.*"), "chat-ends")
    classes = store(ends.groupBy(*key).agg(F.min("conv_id").alias("leader")), "chat-classes")
    leaders = classes.select(conversation(F.col("leader")).alias("conv"), F.col("place").alias("n"), "leader")
    # Proper prefixes of the classes' leaders, once each: a class found among them is a snapshot of a longer one.
    inner = t.select("conv", *key).join(leaders, "conv").where("place < n")
    inner = store(inner.select("leader", *key), "chat-inner")
    maximal = classes.join(inner.select(*key).distinct(), key, "left_anti").select(*key, F.col("leader").alias("self"))
    maximal = store(maximal.withColumn("kept", F.lit(True)), "chat-maximal")
    roof = inner.join(maximal.select(F.col("self").alias("leader")), "leader", "left_semi").groupBy(*key).agg(F.min("leader").alias("roof"))
    fate = store(classes.join(maximal, key, "left").join(roof, key, "left").select(*key, "leader", F.coalesce("kept", F.lit(False)).alias("maximal"), "roof"), "chat-fate")
    out = ends.join(fate, key)
    keep = F.when(F.col("maximal"), F.col("leader")).otherwise(F.col("roof"))
    out = out.select("conv", "conv_id", F.col("place").alias("n_turns"), (F.col("maximal") & F.col("conv_id").eqNullSafe(F.col("leader"))).alias("kept"), keep.alias("keep_id"))
    out = store(out, "chat-out")
    # Texts of kept conversations only, and for the one string that each becomes.
    kept = texts.join(sized(store(out.where("kept").select("conv"), "chat-kept")), "conv", "left_semi")
    parts = kept.groupBy("conv").agg(F.collect_list(F.struct("block", "rank", render(F.col("role"), F.col("text")).alias("part"))).alias("parts"))
    parts = parts.select("conv", F.array_join(F.transform(F.array_sort("parts"), lambda x: x["part"]), "").alias("rendered"))
    out = out.join(parts, "conv", "left")
    return out.select("conv_id", "n_turns", "kept", "keep_id", "rendered", F.sha2("rendered", 256).alias("rendered_sha256"))


ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS part, coalesce(role, '') || chr(1) || coalesce(text, '') || chr(2) AS raw FROM conversations),
p AS (SELECT conv_id, place, string_agg(raw, '') OVER (PARTITION BY conv_id ORDER BY place) AS s FROM t),
c AS (SELECT conv_id, count(*) AS n, string_agg(part, '' ORDER BY place) AS rendered, string_agg(raw, '' ORDER BY place) AS s FROM t GROUP BY conv_id),
k AS (SELECT s, n, min(conv_id) AS leader FROM c GROUP BY s, n),
i AS (SELECT k.leader, p.s, p.place FROM p JOIN k ON k.leader = p.conv_id WHERE p.place < k.n),
m AS (SELECT k.*, NOT EXISTS (SELECT 1 FROM i WHERE i.s = k.s AND i.place = k.n) AS maximal FROM k),
r AS (SELECT i.s, i.place, min(i.leader) AS roof FROM i JOIN m ON m.leader = i.leader AND m.maximal GROUP BY i.s, i.place)
SELECT c.conv_id, c.n AS n_turns, m.maximal AND c.conv_id = m.leader AS kept, CASE WHEN m.maximal THEN m.leader ELSE r.roof END AS keep_id,
  CASE WHEN m.maximal AND c.conv_id = m.leader THEN c.rendered END AS rendered, CASE WHEN m.maximal AND c.conv_id = m.leader THEN sha256(c.rendered) END AS rendered_sha256
FROM c JOIN m ON m.s = c.s AND m.n = c.n LEFT JOIN r ON r.s = c.s AND r.place = c.n
"""
