"""Transcribed pages: their tables as text and as block rows.

A transcription is an array of tables: struct (title, unit_note, rows), a row being an array of cells
struct (text, column_header).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = "array<struct<title:string,unit_note:string,rows:array<array<struct<text:string,column_header:string>>>>>"
#: Blocks of transcriptions are numbered from here, after all native blocks of the page.
FIRST_INDEX = 10_000


def render_table(table: Column) -> Column:
    """Title and unit note joined by a dash, then a line for each row."""
    head = F.concat_ws(" — ", table["title"], table["unit_note"])
    rows = F.array_join(F.transform(table["rows"], lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c["text"], F.lit(""))), " | ")), "\n")
    return F.when(head != "", F.concat(head, F.lit("\n"), rows)).otherwise(rows)


def render_transcription(tables: Column) -> Column:
    """All tables, with a blank line between two."""
    return F.array_join(F.transform(tables, render_table), "\n\n")


def transcription_rows(transcribed: DataFrame, stored: DataFrame, produced_by: str) -> DataFrame:
    """Block rows of transcribed pages (document_id, physical_page, page_image_key, tables) that this producer has not stored yet."""
    page = ["document_id", "physical_page"]
    done = stored.where(F.col("produced_by") == produced_by).select(*page).distinct()
    t = transcribed.join(done, page, "left_anti").select(*page, "page_image_key", F.posexplode("tables").alias("place", "table"))
    headers = F.transform(F.get(F.col("table.rows"), F.lit(0)), lambda c: c["column_header"])
    return t.select(
        *page, F.lit(None).cast("string").alias("printed_page_label"), F.lit("table").alias("block_type"), F.lit("model_transcription").alias("extraction_method"), (F.col("place") + FIRST_INDEX).alias("block_index"),
        render_table(F.col("table")).alias("content"), headers.alias("table_headers"), "page_image_key", F.lit(produced_by).alias("produced_by"),
    )
