"""Geometry of recognised text lines, after observed behaviour: crop mapping, quarter turns, union boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped_box(x: Column, y: Column, scale: Column, offset: Column) -> tuple[Column, Column]:
    """A point of a scaled crop in page coordinates."""
    return x / scale + offset["x"], y / scale + offset["y"]


def quarter_turned(box: dict[str, Column], height: Column) -> dict[str, Column]:
    """A box turned by 90 degrees clockwise on a page of this height: the page's sides are swapped."""
    return {"x0": height - box["y1"], "y0": box["x0"], "x1": height - box["y0"], "y1": box["x1"]}


def line_geometry(lines: DataFrame) -> DataFrame:
    """Union boxes of the lines of each chunk (chunk_id, variant, x0, y0, x1, y1); exact if one variant read them all."""
    return lines.groupBy("chunk_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.count_distinct("variant") == 1).alias("exact"))


def reading_order(lines: DataFrame) -> DataFrame:
    """page_id and text of lines (page_id, text, x0, y0): rows from top to bottom, each from left to right, with
    words hyphenated at a line's end joined."""
    rows = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return rows.select("page_id", F.regexp_replace(F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2"), r"\s*\n\s*", " ").alias("text"))
