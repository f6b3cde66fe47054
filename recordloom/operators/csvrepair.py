"""Repair of untidy CSV texts, over a table of documents at once.

A document is lines in chunks, however many; no step needs a document in one task. A chunk acts on the state of quotes (open or closed) by the parity of its quotes, and starts as many records as it has non-blank lines that find the quotes closed, which it
counts for either state; sums over the chunks give each its state and its first record's number. Records are cut into cells by one possessive pattern for each delimiter. Preamble, width, header, trailing rows and types follow from aggregates that are combined before
they are shuffled, and come back to the rows as facts of their document. A document whose quotes don't pair is for quarantine (``odd_quotes``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.prefix import stored
from recordloom.functions.values import SUMMARY_WORDS, is_boolean, is_date, is_integer, is_null_token, is_numeric, stripped, to_boolean, to_date, to_number, type_of_shares

DELIMITERS = [",", ";", "\t", "|"]
#: Lines of a chunk where a text is one value; documents whose facts are sent to all tasks, with a join by parts of documents beyond; rows of such a part.
CHUNK_LINES, BROADCAST_DOCUMENTS, PART_ROWS = 10_000, 100_000, 50_000


def encoding(content: str = "content") -> Column:
    head = F.hex(F.substring(F.col(content), 1, 3))
    return (
        F.when(head.startswith("EFBBBF"), "utf-8-sig").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")
        .when(F.is_valid_utf8(F.col(content).cast("string")), "utf-8").otherwise("latin-1")
    )


def decoded(docs: DataFrame, content: str = "content") -> DataFrame:
    """Adds encoding and text; a byte order mark isn't part of the text."""
    b = F.col(content)
    text = (
        F.when(F.col("encoding") == "utf-16-le", F.decode(b, "UTF-16LE")).when(F.col("encoding") == "utf-16-be", F.decode(b, "UTF-16BE"))
        .when(F.col("encoding") == "latin-1", F.decode(b, "ISO-8859-1")).otherwise(F.make_valid_utf8(b.cast("string")))
    )
    return docs.withColumn("encoding", encoding(content)).withColumn("text", F.regexp_replace(text, "^﻿", ""))


def cells_of(record: Column, delimiter: str) -> Column:
    """A record's cells: quoted ones may hold delimiters, line ends and doubled quotes."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(rf'{d}("[^"]*+(?:""[^"]*+)*+"|[^{d}]*+)'), F.lit(1))
    return F.transform(found, lambda c: F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), '""', '"')).otherwise(c))


def cells(record: str = "record", delimiter: str = "delimiter") -> Column:
    out = None
    for d in DELIMITERS:
        one = cells_of(F.col(record), d)
        out = F.when(F.col(delimiter) == d, one) if out is None else out.when(F.col(delimiter) == d, one)
    return out


def lines_of(docs: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """document_id, chunk, pos, line of (document_id, text)."""
    lines = docs.select("document_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    return lines.select("document_id", F.floor(F.col("pos") / chunk_lines).alias("chunk"), F.col("pos").cast("long").alias("pos"), "line")


def lines_of_files(spark: SparkSession, path: str, parts: bool = False, latin: bool = False) -> DataFrame:
    """document_id, chunk, pos, line of files that Spark reads in splits: a document is a file, or with ``parts`` a folder of files whose texts follow each other by name. A chunk is a split. UTF-8, or with ``latin`` ISO-8859-1."""
    file = F.col("_metadata.file_path")
    document = F.regexp_replace(file, "/[^/]*$", "") if parts else file
    line = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin else F.make_valid_utf8("value")
    read = spark.read.text(path).select(document.alias("document_id"), F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("chunk"), F.monotonically_increasing_id().alias("pos"), line.alias("line"))
    # a byte order mark stands before the first letter of a file
    marked = F.col("line").startswith("\ufeff") & (F.col("chunk.start") == 0)
    return read.withColumn("line", F.when(marked, F.substring("line", 2, 1 << 30)).otherwise(F.col("line")))


def numbered(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with line_no and row_no (from 0, over the document; null for blank lines between records), and whether the line begins a record and whether it is all of it; and document_id, odd_quotes, n_lines of each document."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    inside = Window.partitionBy("document_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # in a chunk: quotes before the line, and how many lines up to it would begin a record if the chunk began closed or open
    q = lines.withColumn("_own", quotes).withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "chunk").orderBy("pos")))
    q = q.withColumn("_before", F.sum("_own").over(inside) - F.col("_own"))
    some = F.length("line") > 0
    q = q.withColumns({f"_starts{k}": F.sum((some & (F.col("_before") % 2 == k)).cast("int")).over(inside) for k in (0, 1)})
    chunks = q.groupBy("document_id", "chunk").agg(F.count("*").alias("_lines"), F.sum("_own").alias("_quotes"), F.max("_starts0").alias("_s0"), F.max("_starts1").alias("_s1"))
    # a row for each chunk
    earlier = Window.partitionBy("document_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("document_id")
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    c = chunks.withColumns({"_open": before("_quotes") % 2, "_lines_before": before("_lines"), "odd_quotes": F.sum("_quotes").over(whole) % 2 == 1})
    c = c.withColumn("_rows", F.when(F.col("_open") == 0, F.col("_s0")).otherwise(F.col("_s1"))).withColumn("_rows_before", before("_rows"))
    documents = c.groupBy("document_id").agg(F.first("odd_quotes").alias("odd_quotes"), F.sum("_lines").alias("n_lines"))
    at = q.join(c.select("document_id", "chunk", "_open", "_lines_before", "_rows_before", "odd_quotes"), ["document_id", "chunk"])
    begins = (F.col("_before") + F.col("_open")) % 2 == 0
    row = F.col("_rows_before") + F.when(F.col("_open") == 0, F.col("_starts0")).otherwise(F.col("_starts1")) - 1
    out = at.select("document_id", (F.col("_lines_before") + F.col("_n") - 1).alias("line_no"), F.when(~begins | some, row).cast("int").alias("row_no"), "line", "odd_quotes", begins.alias("begins"), (begins & (F.col("_own") % 2 == 0)).alias("whole"))
    return out, documents


def _joined(at: DataFrame) -> DataFrame:
    """Records of numbered lines: most are one line and stay where they are, the others meet by their number."""
    kept = at.where("row_no is not null")
    one = kept.where("whole").select("document_id", "row_no", F.col("line").alias("record"), "odd_quotes")
    many = kept.where("not whole").groupBy("document_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("record"), F.first("odd_quotes").alias("odd_quotes"))
    return one.unionByName(many)


def records(docs: DataFrame) -> DataFrame:
    """document_id, row_no (from 0), record: lines joined while a quote is open; blank lines go. odd_quotes marks documents whose last quote stays open."""
    return _joined(numbered(lines_of(docs))[0])


def delimiter_scores(lines: DataFrame, most: int = 20) -> DataFrame:
    """document_id, delimiter, score of numbered lines (document_id, line_no, line): the share of rows of the commonest width times that width, over the first lines; widths of one don't count."""
    first = lines.where((F.col("line_no") < most) & (F.trim("line") != ""))
    tries = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), F.size(cells_of(F.col("line"), d)).alias("width")) for i, d in enumerate(DELIMITERS)))
    widths = first.select("document_id", F.explode(tries).alias("t")).groupBy("document_id", "t.rank", "t.delimiter", "t.width").agg(F.count("*").alias("n"))
    total = widths.groupBy("document_id", "rank", "delimiter").agg(F.max_by("width", F.struct("n", -F.col("width"))).alias("width"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return total.select("document_id", "rank", "delimiter", F.when(F.col("width") > 1, F.col("most") / F.col("n") * F.col("width")).otherwise(0.0).alias("score"))


def _delimiters(lines: DataFrame) -> DataFrame:
    best = delimiter_scores(lines).groupBy("document_id").agg(F.max_by("delimiter", F.struct("score", -F.col("rank"))).alias("d"), F.max("score").alias("s"))
    return best.select("document_id", F.when(F.col("s") > 0, F.col("d")).otherwise(",").alias("delimiter"))


def delimiters(docs: DataFrame) -> DataFrame:
    """document_id, delimiter: the best score, the first of equals; a comma if none scores."""
    return _delimiters(lines_of(docs).withColumn("line_no", F.col("pos")))


class Facts:
    """Joins of rows with facts of their documents, such that no document's rows meet in one task: the facts are broadcast if there are few documents (``n``), else they are repeated for each part of PART_ROWS rows."""

    def __init__(self, rows: DataFrame, n: int):
        self.few = n <= BROADCAST_DOCUMENTS
        self._parts = None if self.few else stored(rows.groupBy("document_id").agg(F.max("row_no").alias("_most")).select("document_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("_most") / PART_ROWS).cast("int"))).alias("_part")), "parts")

    def join(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        if self.few:
            return rows.join(F.broadcast(facts), "document_id")
        return rows.withColumn("_part", F.floor(F.col("row_no") / PART_ROWS).cast("int")).join(facts.join(self._parts, "document_id"), ["document_id", "_part"]).drop("_part")


def grid(docs: DataFrame) -> DataFrame:
    """document_id, row_no, cells of each record."""
    return records(docs).join(delimiters(docs), "document_id").select("document_id", "row_no", "odd_quotes", cells().alias("cells"))


def _filled(c: str = "cells") -> Column:
    return F.filter(F.col(c), lambda x: stripped(x) != "")


def modal_width(rows: DataFrame) -> DataFrame:
    """document_id, width: of the widths seen in rows 2 to 10 the one that most rows have (the least of equals)."""
    widths = rows.groupBy("document_id", F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.max(F.col("row_no").between(1, 9).cast("int")).alias("seen"), F.max("row_no").alias("_m"))
    only = Window.partitionBy("document_id")
    widths = widths.withColumn("_rows", F.sum("n").over(only)).where((F.col("seen") == 1) | (F.col("_rows") == 1))
    return widths.groupBy("document_id").agg(F.max_by("w", F.struct("n", -F.col("w"))).alias("width"))


def first_rows(rows: DataFrame, width: DataFrame, facts: Facts) -> DataFrame:
    """document_id, n_preamble: the first row that is at least half as wide as usual and has two filled cells. Files of one column have no preamble."""
    real = (F.size("cells") >= F.col("width") * 0.5) & ((F.size(_filled()) > 1) | (F.col("width") == 1))
    return facts.join(rows, width).where(real).groupBy("document_id").agg(F.min("row_no").alias("n_preamble"))


def is_header_like(c: str = "cells") -> Column:
    f = _filled(c)
    numeric = F.size(F.filter(f, is_numeric))
    return (F.size(f) > 0) & ~F.exists(f, lambda x: (F.length(stripped(x)) > 50) | x.contains("\n")) & (numeric / F.greatest(F.size(f), F.lit(1)) < 0.3)


def is_data_like(c: str = "cells") -> Column:
    f = _filled(c)
    return (F.size(f) > 0) & (F.exists(f, lambda x: x.contains("\n")) | (F.size(F.filter(f, lambda x: is_numeric(x) | is_date(x))) / F.greatest(F.size(f), F.lit(1)) > 0.3))


def headers(rows: DataFrame, strict_header: bool = False) -> DataFrame:
    """document_id, header_rows, raw: the first row, merged with the second where that looks like a header and not like data (not if ``strict_header``)."""
    two = rows.where("row_no < 2").groupBy("document_id").agg(F.max(F.when(F.col("row_no") == 0, F.col("cells"))).alias("a"), F.max(F.when(F.col("row_no") == 1, F.col("cells"))).alias("b"))
    merge = F.coalesce(F.col("b").isNotNull() & is_header_like("b") & ~is_data_like("b"), F.lit(False)) & ~F.lit(strict_header)
    trim_all = lambda c: F.transform(F.col(c), stripped)
    both = F.transform(F.arrays_zip(trim_all("a").alias("a"), trim_all("b").alias("b")), lambda p: F.trim(F.concat_ws(" ", F.coalesce(p["a"], F.lit("")), F.coalesce(p["b"], F.lit("")))))
    return two.select("document_id", F.when(merge, 2).otherwise(1).alias("header_rows"), F.when(merge, both).otherwise(F.col("a")).alias("raw"))


def repaired_headers(head: DataFrame) -> DataFrame:
    """document_id, header_rows, col_no, name: trimmed, blank ones named by place, the k-th repetition of a name marked _k."""
    cols = head.select("document_id", "header_rows", F.posexplode("raw").alias("col_no", "raw"))
    named = cols.withColumn("_n", F.when(stripped(F.col("raw")) == "", F.concat(F.lit("column_"), F.col("col_no") + 1)).otherwise(stripped(F.col("raw"))))
    k = F.row_number().over(Window.partitionBy("document_id", "_n").orderBy("col_no")) - 1
    return named.withColumn("_k", k).select("document_id", "header_rows", "col_no", F.when(F.col("_k") > 0, F.concat_ws("_", "_n", "_k")).otherwise(F.col("_n")).alias("name"))


def normalised(rows: DataFrame, head: DataFrame, facts: Facts) -> DataFrame:
    """Data rows padded or cut to the header's width, with the issue where that changed them; row_no from 0 after the header."""
    r = facts.join(rows, head.select("document_id", "header_rows", F.size("raw").alias("_w"))).where("row_no >= header_rows")
    was = F.size("cells")
    row = F.col("row_no") - F.col("header_rows")
    # numbers of rows in issues count from 1
    text = lambda what: F.format_string(f"Row %d: {what} from %d to %d columns", (row + 1).cast("int"), was, F.col("_w"))
    return r.select("document_id", row.alias("row_no"), F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("_w"))), F.lit(1), F.col("_w")).alias("cells"), F.when(was < F.col("_w"), text("padded")).when(was > F.col("_w"), text("truncated")).alias("issue"))


def ends(rows: DataFrame) -> DataFrame:
    """document_id, last (the last row that is no summary row) and n_trailing, the summary rows after it."""
    summary = F.coalesce(F.lower(stripped(F.get("cells", F.lit(0)))).isin(SUMMARY_WORDS), F.lit(False))
    g = rows.groupBy("document_id").agg(F.max(F.when(~summary, F.col("row_no"))).alias("last"), F.max("row_no").alias("_all"))
    return g.where("last is not null").select("document_id", "last", (F.col("_all") - F.col("last")).cast("long").alias("n_trailing"))


def column_types(cells: DataFrame, strict_nulls: bool = False, most: int = 100) -> DataFrame:
    """Of (document_id, col_no, row_no, value): inferred_type from the first ``most`` values that stand for something, null_count, and the first five of them. Each task keeps the first values of its rows, so a column's rows never meet."""
    null = is_null_token(F.col("value"), strict_nulls)
    counts = cells.groupBy("document_id", "col_no").agg(F.count_if(null).alias("null_count"))
    at = F.row_number().over(Window.partitionBy("document_id", "col_no").orderBy("row_no"))
    real = cells.where(~null).withColumn("_at", at).where(F.col("_at") <= most)
    n = lambda test: F.count_if(test(F.col("value")))
    g = real.groupBy("document_id", "col_no").agg(
        F.count("*").alias("_n"), n(is_boolean).alias("_b"), n(is_integer).alias("_i"), n(is_numeric).alias("_f"), n(is_date).alias("_d"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_at") <= 5, F.struct("row_no", "value")))), lambda s: s["value"]).alias("samples"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = counts.join(g, ["document_id", "col_no"], "left")
    return both.select("document_id", "col_no", "null_count", type_of_shares(*map(zero, ("_n", "_b", "_i", "_f", "_d"))).alias("inferred_type"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def cast_cells(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Cells (document_id, row_no, col_no, value) with the value as its column's inferred type has it: number, flag or day beside the text; what doesn't fit its column is null in all three."""
    typed = cells.join(types.select("document_id", "col_no", "inferred_type"), ["document_id", "col_no"])
    of = lambda *kinds: F.col("inferred_type").isin(*kinds)
    return typed.withColumns({"number": F.when(of("integer", "float"), to_number(F.col("value"))), "flag": F.when(of("boolean"), to_boolean(F.col("value"))), "day": F.when(of("date"), to_date(F.col("value")))})


def repaired(docs: DataFrame, strict_header: bool = False, strict_nulls: bool = False) -> dict[str, DataFrame]:
    """``repaired_lines`` of (document_id, text)."""
    return repaired_lines(lines_of(docs), strict_header, strict_nulls)


def repaired_lines(lines: DataFrame, strict_header: bool = False, strict_nulls: bool = False) -> dict[str, DataFrame]:
    """All steps on lines in chunks (document_id, chunk, pos, line): cells (document_id, row_no, col_no, column_name, value), columns, issues and summary; documents with odd quotes apart in quarantine."""
    at, documents = numbered(lines)
    at, documents = stored(at, "lines"), stored(documents, "documents")
    n = documents.count()
    few = (lambda df: F.broadcast(df)) if n <= BROADCAST_DOCUMENTS else (lambda df: df)
    found = _delimiters(at)
    # every output is made of the cells: they are written once
    g = stored(_joined(at.where("not odd_quotes")).join(few(found), "document_id").select("document_id", "row_no", "delimiter", cells().alias("cells")), "cells")
    facts = Facts(g, n)
    first = stored(first_rows(g, modal_width(g), facts), "first_rows")
    body = facts.join(g, first).where("row_no >= n_preamble").select("document_id", (F.col("row_no") - F.col("n_preamble")).alias("row_no"), "cells")
    head = stored(headers(body, strict_header), "headers")
    names = repaired_headers(head)
    rows = normalised(body, head, facts)
    last = stored(ends(rows), "ends")
    data = facts.join(rows, last).where(F.col("row_no") <= F.col("last")).select("document_id", "row_no", "cells", "issue")
    long = data.select("document_id", "row_no", F.posexplode("cells").alias("col_no", "value"))
    by_place = names.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "name"))).alias("_names"))
    named = facts.join(long, by_place).select("document_id", "row_no", "col_no", F.element_at("_names", F.col("col_no")).alias("column_name"), "value")
    types = column_types(long, strict_nulls)
    counts = g.groupBy("document_id").agg(F.count("*").alias("total_raw_rows"), F.first("delimiter").alias("delimiter"))
    kept = data.groupBy("document_id").agg(F.count("*").alias("n_rows"), F.count("issue").alias("n_issues"))
    summary = counts.join(first, "document_id", "left").join(head.select("document_id", "header_rows"), "document_id", "left").join(kept.join(last.select("document_id", "n_trailing"), "document_id"), "document_id", "left")
    return {
        "cells": named, "columns": names.join(types, ["document_id", "col_no"], "left").select("document_id", "col_no", "name", F.coalesce("inferred_type", F.lit("null")).alias("inferred_type"), "null_count", "samples"),
        "issues": data.where("issue is not null").select("document_id", "row_no", "issue"), "summary": summary, "quarantine": documents.where("odd_quotes").select("document_id").withColumn("reason", F.lit("odd_quotes")),
    }
