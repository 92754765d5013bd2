"""Quality rules with cross-document line frequency, in DataFrame functions only.

Rules on each text: words, characters in words, symbols, repeated lines and words in repeated
five-word windows. Across documents: lines are normalised (case, white space) and hashed, and the
distinct documents (doc_ids) of each host (the source) that hold a line are counted, copies of one text
each for itself. Lines in more documents of their host than the limit are removed, and a document that
has too little left is rejected. The limit is one count for every host, small or large, so a line is
judged by how often it is repeated and not by the size of its host.

A line counts once a document before anything is shuffled, and counts are summed where they arise, so a
line that most documents share costs one row a task. Lines above the limit are sent to every task only
if they are few (`MOST_BROADCAST`, counted first), else joined by a shuffle that is salted by row.

Nulls: a null text has no words and fails; a null source is a host of its own; a null doc_id is
kept as it is, and all rows without one count as one document. Rows that repeat a doc_id count as one
document and are judged each for itself. Ties do not arise. Very long texts are taken whole. An empty
table gives no rows. Only doc_id, text and source are read; clashing further columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, store, text_of

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WIDTH = 5


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """Words in windows (given by hash, in order) that occur twice or more."""

    def spread(s: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["g"] == x["g"]))
        at = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
        steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WIDTH), F.coalesce(F.get(p, i + 1) - x, F.lit(WIDTH))))
        return bound(at, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(bound(pairs, spread))


def _word_figures(words: Column) -> Column:
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))
    repeat = F.when(n < WIDTH + 1, F.lit(0)).otherwise(bound(grams, _covered))
    return F.struct(n.alias("n"), repeat.alias("repeat"))


def figures(docs: DataFrame) -> DataFrame:
    """The rules' figures of every row, with its lines (hash, words)."""
    text = text_of(docs)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    spaceless = F.length(F.translate(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    flat = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.transform(F.split(flat, "\n"), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    return docs.select(
        "doc_id", "source", bound(words, _word_figures).alias("f"), spaceless.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        bound(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.filter(lines, lambda x: x["w"] > 0).alias("lines"), F.monotonically_increasing_id().alias("row"),
    )


#: Up to so many lines above the limit are sent to every task (about 16 bytes and the host's name each).
MOST_BROADCAST = 200_000
SALTS = 32


def _host(source) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def frequent_lines(table: DataFrame, least_documents: int) -> DataFrame:
    """(host, h) of lines in more than `least_documents` distinct documents of the host."""
    # Ids repeated on several rows are found first: only their lines have to go through a distinct.
    twice = store(table.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "rules-repeated")
    same = table["doc_id"].eqNullSafe(twice["doc_id"])
    each = lambda t: t.select(_host(F.col("source")).alias("host"), "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    once = each(table.join(twice, same, "left_anti")).groupBy("host", "h").agg(F.count("*").alias("n"))
    again = each(table.join(twice, same, "left_semi")).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    sums = once.unionByName(again).groupBy("host", "h").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") > least_documents).select("host", "h")


def line_hits(table: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, removed): words in frequent lines of each row that has any."""
    lines = table.select("row", _host(F.col("source")).alias("host"), F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    if frequent.count() <= MOST_BROADCAST:
        hit = lines.join(F.broadcast(frequent), ["host", "h"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])
    return hit.groupBy("row").agg(F.sum("w").alias("removed"))


def quality_rules(docs: DataFrame, least_documents: int = 10, least_left: float = 0.3) -> DataFrame:
    """One row per document with the figures, base_failed, removed words and kept.

    A line is removed if it is in more than `least_documents` distinct documents of its host; a
    document is depleted if less than `least_left` of its words, or fewer than 10, remain.
    """
    table = store(figures(docs), "rules-figures")
    frequent = store(frequent_lines(table, least_documents), "rules-lines")
    removed = store(line_hits(table, frequent), "rules-hits")
    out = table.drop("lines").join(removed, "row", "left").withColumn("n_words", F.col("f.n").cast("long"))
    out = out.withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long")).withColumn("n_repeat_words", F.col("f.repeat").cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < 10) | (left < F.col("n_words") * least_left))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "n_removed_words")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest([w[i:i + 4] FOR i IN range(1, len(w) - 3)]) AS g FROM w WHERE len(w) >= 5),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
n AS (SELECT rid, sum(c) AS rep FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS c FROM r) GROUP BY rid),
x AS (SELECT rid, source, doc_id, unnest(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS line FROM d),
y AS (SELECT rid, source, doc_id, trim(line, ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw FROM x),
q AS (SELECT source, line, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS c FROM y WHERE lw > 0 GROUP BY ALL),
b AS (SELECT source, line FROM q WHERE c > 10),
m AS (SELECT y.rid, sum(y.lw) AS removed FROM y JOIN b ON y.source IS NOT DISTINCT FROM b.source AND y.line = b.line GROUP BY y.rid),
z AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n.rep, 0)::BIGINT AS n_repeat_words, coalesce(m.removed, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN n ON n.rid = w.rid LEFT JOIN m ON m.rid = w.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < n_words * 0.3::DOUBLE)) AS kept,
  n_removed_words FROM z
"""
