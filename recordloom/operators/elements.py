"""Layout elements of pages: assembly from spans, classification, order, and exclusion by tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.prefix import stored

from recordloom.operators.extraction import KEY_VALUE

# Font size of headings, their most lines, and where the footer begins.
HEADING_SIZE, HEADING_LINES, FOOTER_FROM = 14.0, 3, 0.9


def kind(text: str = "text", y0: str = "y0", font_size: str = "font_size", is_bold: str = "is_bold", line_count: str = "line_count", page_height: str = "page_height") -> Column:
    """footer, heading, kv_pair, list_item or paragraph; the first that holds."""
    t = F.col(text)
    return (
        F.when(F.col(y0) > F.col(page_height) * FOOTER_FROM, "footer")
        .when(((F.col(font_size) >= HEADING_SIZE) | F.col(is_bold)) & (F.col(line_count) <= HEADING_LINES), "heading")
        .when((F.col(line_count) == 1) & t.rlike(KEY_VALUE), "kv_pair")
        .when(t.rlike(r"^\s*[•\-●○▪]") | t.rlike(r"^\d+[.)]\s"), "list_item")
        .otherwise("paragraph")
    )


def blocks_of_spans(spans: DataFrame) -> DataFrame:
    """Spans (document_id, page, block_no, line_no, span_no, text, font_size, font_name) as blocks; blank ones go."""
    key = ["document_id", "page", "block_no"]
    lines = spans.groupBy(*key, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("line"), F.max("font_size").alias("font_size"), F.max(F.lower("font_name").contains("bold")).alias("is_bold")
    )
    blocks = lines.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"), F.max("font_size").alias("font_size"), F.max("is_bold").alias("is_bold"), F.count("*").alias("line_count")
    )
    return blocks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


#: Pairs of blocks and tables of a page beyond which they are dealt to tiles; edges of tiles, as powers of two.
CROWDED, EDGES = 100_000, (4, 6, 8, 10, 12, 16, 24, 40, 64, 1023)
_BOX = ["document_id", "page", "x0", "y0", "x1", "y1"]


def _tiled(boxes: DataFrame) -> DataFrame:
    """A row for each tile that a box may share with another: of each edge that isn't shorter than the box, the tiles (four at most) that it touches; ``own`` marks those of the shortest such edge."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    first = F.coalesce(*(F.when(size <= 2.0**e, i) for i, e in enumerate(EDGES)))
    edge = F.element_at(F.array(*(F.lit(2.0**e) for e in EDGES)), F.col("level") + 1)
    at = lambda c: F.floor(F.col(c) / edge)
    leveled = boxes.where(size >= 0).withColumn("_first", first).withColumn("level", F.explode(F.sequence("_first", F.lit(len(EDGES) - 1)))).withColumn("own", F.col("level") == F.col("_first"))
    return leveled.withColumn("tx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("ty", F.explode(F.sequence(at("y0"), at("y1")))).drop("_first")


def meeting_boxes(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """The distinct rectangles of blocks (document_id, page, x0, y0, x1, y1) that meet a table of their page, by tiles: of two that meet, the tiles of the larger one's own edge have both. A crowded page is many keys."""
    key = ["document_id", "page", "level", "tx", "ty"]
    b, t = _tiled(blocks.select(*_BOX).distinct()), _tiled(tables.select(*_BOX).distinct())
    t = t.select(*(F.col(c).alias(f"t_{c}") for c in (*key, "own", "x0", "y0", "x1", "y1")))
    both = F.col("own") | F.col("t_own")
    for c in key:
        both = both & (F.col(c) == F.col(f"t_{c}"))
    both = both & (F.col("x0") < F.col("t_x1")) & (F.col("t_x0") < F.col("x1")) & (F.col("y0") < F.col("t_y1")) & (F.col("t_y0") < F.col("y1"))
    return b.join(t, both, "left_semi").select(*_BOX).distinct()


def outside_tables(blocks: DataFrame, tables: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Blocks whose rectangle meets no table of their page. Pages with more than ``crowded`` pairs are dealt to tiles; repeated rectangles share their fate."""
    page = ["document_id", "page"]
    counts = blocks.groupBy(*page).agg(F.count("*").alias("_b")).join(tables.groupBy(*page).agg(F.count("*").alias("_t")), page).where(F.col("_b") * F.col("_t") > crowded).select(*page)
    t = tables.select(*(F.col(c).alias(f"t_{c}") for c in _BOX))
    meets = (F.col("document_id") == F.col("t_document_id")) & (F.col("page") == F.col("t_page")) & (F.col("x0") < F.col("t_x1")) & (F.col("t_x0") < F.col("x1")) & (F.col("y0") < F.col("t_y1")) & (F.col("t_y0") < F.col("y1"))
    if not counts.limit(1).count():
        return blocks.join(t, meets, "left_anti")
    counts = stored(counts, "crowded_pages")
    few = blocks.join(counts, page, "left_anti").join(t, meets, "left_anti")
    many = blocks.join(counts, page, "left_semi")
    met = meeting_boxes(many, tables.join(counts, page, "left_semi"))
    return few.unionByName(many.join(met, _BOX, "left_anti"))


def ordinals(elements: DataFrame) -> DataFrame:
    """Places in the document, from 0: by page, text before tables, block number."""
    return elements.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "is_table", "block_no")) - 1)


def needs_ocr(pages: DataFrame) -> DataFrame:
    """document_id, needs_ocr: the first page has no text."""
    return pages.groupBy("document_id").agg(F.min_by("text", "page").alias("t")).select("document_id", (F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"\s+", " ")) == "").alias("needs_ocr"))


def rendered_table(cells: str = "cells") -> Column:
    """An array of rows of cells as text: header, a rule of 40 dashes, rows; null cells are empty."""
    rows = F.transform(F.col(cells), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(F.lit("-" * 40)), F.slice(rows, 2, 1 << 30)), "\n")


def box(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    width, height = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    return F.struct(width.alias("width"), height.alias("height"), (width * height).alias("area"))


def joined_tables(tables: DataFrame) -> DataFrame:
    """Tables (document_id, page, header, rows) of which consecutive ones repeat the header as one: header, first and last page, all rows."""
    w = Window.partitionBy("document_id").orderBy("page")
    starts = tables.withColumn("_new", (~F.col("header").eqNullSafe(F.lag("header").over(w))).cast("int")).withColumn("table_no", F.sum("_new").over(w))
    return starts.groupBy("document_id", "table_no").agg(F.first("header").alias("header"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "rows"))), lambda s: s["rows"])).alias("rows"))
