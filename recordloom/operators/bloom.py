"""Bloom filters as tables: which parts of a log may hold a key, so that a landing reads those parts alone before its exact anti join. A filter is rows of 64-bit words; filters of the same size merge by or, so each version of a log brings its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a part's filter, and places of a key in it: about one key in a hundred of 100 000 is found by mistake.
BITS, PLACES = 1 << 20, 7


def _places(keys: list[str], bits: int, places: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.pmod(F.xxhash64(*(F.col(k) for k in keys), i), F.lit(bits)))


def built(rows: DataFrame, keys: list[str], parts: list[str], bits: int = BITS, places: int = PLACES) -> DataFrame:
    """parts, word, ones: the filter of each part's keys."""
    at = rows.select(*parts, F.explode(_places(keys, bits, places)).alias("_at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))
    return at.groupBy(*parts, F.floor(F.col("_at") / 64).alias("word")).agg(F.bit_or(one).alias("ones"))


def merged(filters: DataFrame, parts: list[str]) -> DataFrame:
    """Filters of the same size of which several rows say a word: one row for each."""
    return filters.groupBy(*parts, "word").agg(F.bit_or("ones").alias("ones"))


def may_hold(rows: DataFrame, keys: list[str], filters: DataFrame, parts: list[str], bits: int = BITS, places: int = PLACES, dealt: dict[str, Column] | None = None) -> DataFrame:
    """The distinct keys with each part whose filter doesn't rule them out. Null keys are never held. ``dealt``: columns of ``parts`` that follow from the key; a key is then asked of the filters of its own parts alone, not of all."""
    dealt = dealt or {}
    known = rows.select(*keys).dropna().distinct()
    asked = known.select(*keys, *(c.alias(n) for n, c in dealt.items()), F.posexplode(_places(keys, bits, places)).alias("_i", "_at")).withColumn("word", F.floor(F.col("_at") / 64))
    hit = F.call_function("shiftright", F.col("ones"), (F.col("_at") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    found = asked.join(filters, ["word", *dealt]).where(hit).groupBy(*keys, *parts).agg(F.count("*").alias("_n"))
    return found.where(F.col("_n") == places).select(*keys, *parts)


def new_rows(incoming: DataFrame, log: DataFrame, keys: list[str], filters: DataFrame, parts: list[str], bits: int = BITS, places: int = PLACES, dealt: dict[str, Column] | None = None) -> tuple[DataFrame, list[tuple]]:
    """The rows whose key the log lacks, and the parts that were read for it: those that some incoming key may be in. ``parts`` are the columns that the log is partitioned by; a part found by mistake is read and changes nothing. For ``dealt`` see ``may_hold``."""
    held = may_hold(incoming, keys, filters, parts, bits, places, dealt).select(*parts).distinct()
    found = sorted(tuple(r) for r in held.collect())  # a row for each part of the log
    where = F.lit(False)
    by_first: dict = {}
    for p in found:
        by_first.setdefault(p[:-1], []).append(p[-1])
    for head, last in by_first.items():
        same = F.col(parts[-1]).isin(last)
        for c, v in zip(parts, head):
            same = same & (F.col(c) == F.lit(v))
        where = where | same
    return incoming.join(log.where(where).select(*keys), keys, "left_anti"), found
