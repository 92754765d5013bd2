"""Page layout: positioned runs of text to gutters, regions, lines, blocks, kinds and labels.

Runs: document_id, physical_page, text, x, y, width, height, reading_index (y grows upwards), page
width_pt and height_pt. A page is the unit: every operator groups or windows by (document_id,
physical_page), so pages spread over the cluster and no page needs another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.base import SPACE, bound, first_match

PAGE = ["document_id", "physical_page"]
# Distances in text heights, and the limits of the classification.
GUTTER, LINE, GAP = 2.5, 0.5, 1.6
SPARSE_CHARS, SPARSE_RUNS, NUMERIC_RATIO, ALIGNED, MEAN_RUN, LEAST_RUNS, BUCKET = 700, 25, 0.3, 4, 15, 8, 3
NUMERIC = rf"^[₹$€£]?{SPACE}?\(?-?[0-9][0-9,]*(\.[0-9]+)?\)?{SPACE}?%?$"


def text_heights(runs: DataFrame) -> DataFrame:
    """Median height of a page's runs (those above 0), 10 if there is none."""
    return runs.groupBy(*PAGE).agg(F.coalesce(F.percentile(F.when(F.col("height") > 0, F.col("height")), F.lit(0.5)), F.lit(10.0)).alias("text_height"))


def gutters(runs: DataFrame, least_width: Column | None = None) -> DataFrame:
    """Gaps (x0, x1, gutter_width) of whole points that no run of the page covers, inside the text.

    least_width may use text_height; by default it is 2.5 text heights. Gaps and islands over the
    runs' extents, clamped to the page.
    """
    width = F.ceil("width_pt")
    r = runs.join(text_heights(runs), PAGE)
    r = r.select(*PAGE, "text_height", F.greatest(F.lit(0), F.floor("x")).alias("from"), F.least(width, F.ceil(F.col("x") + F.col("width"))).alias("to")).where("from <= to")
    far = F.max("to").over(Window.partitionBy(*PAGE).orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    g = r.withColumn("far", far).where(F.col("from") - F.col("far") > 1)
    g = g.select(*PAGE, (F.col("far") + 1).alias("x0"), (F.col("from") - 1).alias("x1"), (F.col("from") - F.col("far") - 1).alias("gutter_width"), "text_height")
    return g.where(F.col("gutter_width") >= (F.col("text_height") * GUTTER if least_width is None else least_width)).drop("text_height")


def regions(runs: DataFrame, least_width: Column | None = None) -> DataFrame:
    """Runs with region, the number of their column from the left among columns that hold runs."""
    middle = gutters(runs, least_width).groupBy(*PAGE).agg(F.array_sort(F.collect_list((F.col("x0") + F.col("x1")) / 2)).alias("edges"))
    r = runs.join(middle, PAGE, "left").withColumn("center", F.col("x") + F.col("width") / 2)
    slot = F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e <= F.col("center")))
    return r.withColumn("slot", slot).withColumn("region", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("slot")) - 1).drop("edges", "slot", "center")


def lines(runs: DataFrame) -> DataFrame:
    """Lines of each region: line, text, y, x0, x1, height and its runs in order of x.

    From the top down a run joins the open line if it lies within half a text height of the line's
    first run, not of the run before; so the page's runs are folded in order.
    """
    r = runs if "region" in runs.columns else regions(runs)
    r = r.drop("text_height").join(text_heights(runs), PAGE)
    item = F.struct((-F.col("y")).alias("down"), "x", "reading_index", "y", "width", "height", "text")
    g = r.groupBy(*PAGE, "region").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("text_height").alias("text_height"))

    def fold(items: Column) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

        def step(s: Column, i: Column) -> Column:
            new = s["anchor"].isNull() | (F.abs(s["anchor"] - i["y"]) > F.col("text_height") * LINE)
            n = s["line"] + new.cast("int")
            return F.struct(F.when(new, i["y"].cast("double")).otherwise(s["anchor"]).alias("anchor"), n.alias("line"), F.concat(s["lines"], F.array(n)).alias("lines"))

        return F.aggregate(items, start, step, lambda s: s["lines"])

    z = g.select(*PAGE, "region", "text_height", F.explode(F.arrays_zip("items", fold(F.col("items")).alias("line"))).alias("z"))
    z = z.select(*PAGE, "region", "text_height", F.col("z.line").alias("line"), F.col("z.items").alias("i"))
    order = F.struct(F.col("i.x").alias("x"), F.col("i.down").alias("down"), F.col("i.reading_index").alias("reading_index"), F.col("i.y").alias("y"), F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("i.text").alias("text"))
    out = z.groupBy(*PAGE, "region", "line").agg(F.array_sort(F.collect_list(order)).alias("items"), F.first("text_height").alias("text_height"))
    return out.select(
        *PAGE, "region", "line", F.array_join(F.transform("items", lambda i: i["text"]), " ").alias("text"), F.get("items", F.lit(0))["y"].alias("y"), F.array_min(F.transform("items", lambda i: i["x"])).alias("x0"),
        F.array_max(F.transform("items", lambda i: i["x"] + i["width"])).alias("x1"), F.array_max(F.transform("items", lambda i: i["height"])).alias("height"), "items", "text_height",
    )


def blocks(lines_: DataFrame) -> DataFrame:
    """Blocks of each region: a new one begins where the next line is more than 1.6 text heights below."""
    down = Window.partitionBy(*PAGE, "region").orderBy("line")
    x = lines_.withColumn("new", (F.coalesce(F.lag("y").over(down) - F.col("y") > F.col("text_height") * GAP, F.lit(False))).cast("int"))
    x = x.withColumn("block", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.struct("line", "text", "x0", "x1", "y", "height", "items")
    g = x.groupBy(*PAGE, "region", "block").agg(
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("in_order"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y").alias("y_top"), F.min("y").alias("y_bottom"), F.count("*").alias("n_lines"),
        F.first("text_height").alias("text_height"), F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.collect_list(line)).alias("lines"),
    )
    return g.withColumn("text", F.array_join(F.transform("in_order", lambda l: l["text"]), "\n")).drop("in_order")


def run_features(runs: DataFrame, *keys: str) -> DataFrame:
    """chars, runs, numeric_ratio, aligned_columns (3-point buckets with three runs or more), mean_run by keys."""
    b = runs.withColumn("bucket", F.floor(F.col("x") / BUCKET + 0.5))
    per = b.groupBy(*keys, "bucket").agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("n"), F.count_if(F.col("text").rlike(NUMERIC)).alias("m"))
    out = per.groupBy(*keys).agg(F.sum("c").alias("chars"), F.sum("n").alias("runs"), F.sum("m").alias("m"), F.count_if(F.col("n") >= 3).alias("aligned_columns"))
    return out.select(*keys, "chars", "runs", (F.col("m") / F.col("runs")).alias("numeric_ratio"), "aligned_columns", (F.col("chars") / F.col("runs")).alias("mean_run"))


def structure_score() -> Column:
    yes = lambda c: c.cast("int")
    return yes(F.col("numeric_ratio") >= NUMERIC_RATIO) + yes(F.col("aligned_columns") >= ALIGNED) + yes(F.col("mean_run") <= MEAN_RUN)


def classify_regions(region_runs: DataFrame, block_runs: DataFrame, all_regions: DataFrame | None = None) -> DataFrame:
    """kind of each region: empty, sparse, structured or narrative. block_runs: runs with region and block.

    all_regions (document_id, physical_page, region), if given, names regions that may hold no runs: these are empty.
    """
    f = run_features(region_runs, *PAGE, "region").withColumn("score", structure_score())
    tabular = run_features(block_runs, *PAGE, "region", "block").where(F.col("runs") >= LEAST_RUNS).withColumn("s", structure_score())
    tabular = tabular.groupBy(*PAGE, "region").agg(F.bool_or(F.col("s") >= 2).alias("tabular"))
    f = f.join(tabular, [*PAGE, "region"], "left")
    if all_regions is not None:
        f = all_regions.select(*PAGE, "region").distinct().join(f, [*PAGE, "region"], "left").na.fill(0, ["chars", "runs", "aligned_columns"]).na.fill(0.0, ["numeric_ratio", "mean_run"])
    kind = first_match([
        (F.col("runs") == 0, "empty"), ((F.col("chars") < SPARSE_CHARS) & (F.col("runs") < SPARSE_RUNS), "sparse"), ((F.col("score") >= 2) | F.coalesce("tabular", F.lit(False)), "structured"),
    ], "narrative")
    return f.withColumn("kind", kind).drop("score", "tabular")


def classify_pages(pages: DataFrame, region_kinds: DataFrame) -> DataFrame:
    """kind and visual_route of each page (pages: document_id, physical_page)."""
    k = region_kinds.groupBy(*PAGE).agg(F.sum("chars").alias("chars"), F.bool_or(F.col("kind") == "structured").alias("s"), F.bool_or(F.col("kind") == "narrative").alias("n"))
    out = pages.select(*PAGE).distinct().join(k, PAGE, "left")
    kind = first_match([(F.coalesce("chars", F.lit(0)) == 0, "empty"), (F.col("s"), "structured"), (F.col("n"), "narrative")], "sparse")
    return out.select(*PAGE, kind.alias("kind"), (kind == "structured").alias("visual_route"))


def block_types(blocks_: DataFrame, page_kinds: DataFrame) -> DataFrame:
    """block_type of each block: heading, table, list or paragraph."""

    def share(test) -> Column:
        return F.size(F.filter("lines", test)) >= F.size("lines") * 0.8

    one = F.get("lines", F.lit(0))
    heading = (F.size("lines") == 1) & (one["height"] > F.col("text_height") * 1.15) & (F.length(one["text"]) <= 80)
    listed = (F.size("lines") >= 3) & share(lambda l: F.abs(l["x0"] - one["x0"]) < 2) & share(lambda l: F.length(l["text"]) <= 60)
    kind = first_match([(heading, "heading"), ((F.col("kind") == "structured") & (F.size("items") >= LEAST_RUNS), "table"), (listed, "list")], "paragraph")
    return blocks_.join(page_kinds.select(*PAGE, "kind"), PAGE).withColumn("block_type", kind)


def page_labels(runs: DataFrame, margin: float = 0.07, most: int = 2) -> DataFrame:
    """Printed label of each page that has one: short numbers in the top or bottom margin, joined by a dash."""
    near = (F.col("y") <= F.col("height_pt") * margin) | (F.col("y") >= F.col("height_pt") - F.col("height_pt") * margin)
    shaped = F.col("text").rlike("^[0-9]{1,4}$") | F.col("text").rlike("^(?i)[ivxlcdm]{1,7}$")
    c = runs.where(near & shaped).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x", "reading_index", "text"))).alias("c")).where(F.size("c") <= most)
    return c.select(*PAGE, F.array_join(F.array_distinct(F.transform("c", lambda x: x["text"])), "-").alias("printed_page_label"))


def bind_to_axis(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Each value of a page with its nearest axis label by x: label, delta_x, ambiguous.

    values: document_id, physical_page, value_id, x; labels: document_id, physical_page, label, x.
    Unbound if the nearest is more than half the median column pitch away, or the next nearest less
    than a quarter of the pitch further. A page's labels come as one sorted array beside each value.
    """
    l = labels.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x", "label"))).alias("labels"))
    gaps = Window.partitionBy(*PAGE).orderBy("x", "label")
    pitch = labels.withColumn("gap", F.col("x") - F.lag("x").over(gaps)).groupBy(*PAGE).agg(F.percentile("gap", F.lit(0.5)).alias("pitch"))
    v = values.join(l, PAGE, "left").join(pitch, PAGE, "left").withColumn("pitch", F.when(F.col("pitch") > 0, F.col("pitch")))
    near = F.array_sort(F.transform(F.coalesce("labels", F.array().cast("array<struct<x:double,label:string>>")), lambda e, i: F.struct(F.abs(e["x"] - F.col("x")).alias("d"), i.alias("i"), e["label"].alias("label"))))

    def judge(n: Column) -> Column:
        first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        far = first["d"] > F.col("pitch") * 0.5
        close = F.coalesce(second["d"] - first["d"] < F.col("pitch") * 0.25, F.lit(False))
        label = F.when(F.col("pitch").isNull() | ~(far | close), first["label"])
        return F.struct(label.alias("label"), first["d"].alias("delta_x"), (F.col("pitch").isNull() | far | close | first.isNull()).alias("ambiguous"))

    return v.withColumn("b", bound(near, judge)).select(*PAGE, "value_id", "b.label", "b.delta_x", "b.ambiguous")


def reading_text(runs: DataFrame) -> DataFrame:
    """Text of a page: its runs in reading order, joined by spaces."""
    g = runs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("reading_index", "text"))).alias("r"))
    return g.select(*PAGE, F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))


def layout_text(blocks_: DataFrame) -> DataFrame:
    """Text of a page: its blocks by region, joined by blank lines."""
    g = blocks_.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("region", "block", "text"))).alias("b"))
    return g.select(*PAGE, F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def is_legitimately_empty(kind: Column) -> Column:
    """Pages of which no blocks are expected."""
    return kind.isin("empty", "sparse")


def block_rows(typed: DataFrame, labels: DataFrame, stored: DataFrame, produced_by: str = "parse@1") -> DataFrame:
    """Rows to store for the blocks of pages: index over regions and blocks, content, box, label.

    typed: blocks with block_type and the page's kind. Empty and sparse pages give none, nor do pages that this
    producer has stored already (stored: document_id, physical_page, produced_by).
    """
    done = stored.where(F.col("produced_by") == produced_by).select(*PAGE).distinct()
    b = typed.where(~is_legitimately_empty(F.col("kind"))).join(done, PAGE, "left_anti").join(labels.select(*PAGE, "printed_page_label"), PAGE, "left")
    index = F.row_number().over(Window.partitionBy(*PAGE).orderBy("region", "block")) - 1
    items = F.transform("items", lambda i: F.struct(i["text"].alias("text"), i["x"].alias("x"), i["y"].alias("y"), i["width"].alias("width"), i["height"].alias("height"), i["reading_index"].alias("reading_index")))
    return b.select(
        *PAGE, "printed_page_label", "block_type", F.lit("native_text").alias("extraction_method"), index.alias("block_index"), F.col("text").alias("content"), items.alias("positioned_items"),
        F.col("x0").alias("bbox_x"), F.col("y_bottom").alias("bbox_y"), (F.col("x1") - F.col("x0")).alias("bbox_width"), (F.col("y_top") - F.col("y_bottom")).alias("bbox_height"), F.lit(produced_by).alias("produced_by"),
    )
