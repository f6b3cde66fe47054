"""Physical layout: weights and skew, bins of even weight, order along a space-filling curve, compaction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.prefix import running_sums


def weight(size: Column) -> Column:
    return F.when(size > 10 * 1024 * 1024, 10).when(size > 1024 * 1024, 3).otherwise(1)


def by_weight(df: DataFrame, size: str, key: str, order: list[str], bins: int | None = None) -> DataFrame:
    """Rows dealt to bins of even total weight, in a global order. Without ``bins``, a third of the total weight, at least four."""
    weighted = df.withColumn("_weight", F.coalesce(weight(F.col(size)), F.lit(1)))
    total = weighted.agg(F.sum("_weight")).first()[0] or 0
    n = bins or max(4, total // 3)
    summed = running_sums(weighted, order, {"_cum": "_weight"})
    return summed.withColumn("bin", F.least(F.floor((F.col("_cum") - F.col("_weight")) * n / F.lit(max(total, 1))), F.lit(n - 1)).cast("int")).drop("_cum", "_weight")


#: Partitions for each core at most while none passes PARTITION_BYTES; and the bytes that more are made for.
PARTITIONS_A_CORE, PARTITION_BYTES = 4, 64 << 20


def by_salt(df: DataFrame, size: str, key: str) -> DataFrame:
    """Rows dealt by a hash of their key to as many partitions as their weights ask for, a third of the total weight. That many small documents would make tasks that are all overhead, so there are no more than PARTITIONS_A_CORE for each core, unless their bytes ask for more."""
    total = df.agg(F.sum(F.coalesce(weight(F.col(size)), F.lit(1))).alias("weight"), F.sum(F.col(size).cast("double")).alias("bytes")).first()
    most = max(PARTITIONS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, math.ceil((total.bytes or 0) / PARTITION_BYTES))
    return df.repartition(max(4, min(int(total.weight or 0) // 3, most)), key)


#: Times an even share that a part of ``in_parts`` may hold without being dealt anew.
UNEVEN = 2


def in_parts(df: DataFrame, n: int) -> DataFrame:
    """Rows in ``n`` partitions, to be written as so many files. Where the splits that they are read from can be put together to ``n`` parts, none empty or above UNEVEN times its share, no row is shuffled: a task then reads its part as it is stored, which is smaller than rows of a shuffle.
    Else (few or uneven splits) they are dealt anew. Counts the rows first, so they should come from files or be cheap to make."""
    joined = df.coalesce(n)
    counts = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("part")).count().collect()]  # n numbers at most
    return joined if len(counts) == n and max(counts) * n <= UNEVEN * sum(counts) else df.repartition(n)


def skew(df: DataFrame, size: str, by: str | None = None) -> DataFrame:
    """Partitions (of Spark, or of a table by the column ``by``), the greatest over the upper median count of rows, least and greatest (an empty table has none)."""
    parts = df.groupBy((F.spark_partition_id() if by is None else F.col(by)).alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    g = parts.agg(F.count("*").alias("partitions"), F.sort_array(F.collect_list("n")).alias("_n"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("bytes").alias("most_bytes"))
    median = F.get("_n", F.floor(F.size("_n") / 2).cast("int"))
    return g.select("partitions", F.when(F.col("partitions") == 0, 0.0).otherwise(F.col("most") / median).alias("skew_ratio"), "least", "most", "most_bytes")


def interleaved(*columns: Column, bits: int = 8) -> Column:
    """A key whose order is near in all columns (each 0 to 2**bits - 1)."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + i))
    return out


#: Rows that boundaries of strings are taken from, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 256


def _rankable(df: DataFrame, column: str) -> tuple[Column, bool]:
    """What ranks a column, and whether it is a string: numbers, dates, times and booleans as doubles, strings as they are, bytes by their hexadecimal digits."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01")).cast("double"), False
    if kind == "boolean":
        return c.cast("int").cast("double"), False
    if kind == "binary":
        return F.hex(F.substring(c, 1, SAMPLE_CHARS // 2)), True
    if kind == "string" or kind.startswith(("char", "varchar")):
        return F.substring(c, 1, SAMPLE_CHARS), True
    return c.cast("double"), False


def boundaries(df: DataFrame, columns: list[str], n: int) -> dict[str, list]:
    """For each column n - 1 values in its own order, between which about equally many rows lie; a value that many rows have stands several times. Numbers by a mergeable sketch of all rows, strings by SAMPLE_ROWS rows drawn from all."""
    keys = {c: _rankable(df, c) for c in columns}
    numbers, strings = [c for c in columns if not keys[c][1]], [c for c in columns if keys[c][1]]
    out: dict[str, list] = {}
    if numbers:
        shares = [i / n for i in range(1, n)]
        out |= df.agg(*(F.percentile_approx(keys[c][0], shares, 1000).alias(c) for c in numbers)).first().asDict()
    if strings:
        drawn = df.select(*(keys[c][0].alias(c) for c in strings)).orderBy(F.rand(7)).limit(SAMPLE_ROWS)
        lists = drawn.agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in strings))  # one row of SAMPLE_ROWS values
        cut = lambda c: F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get(c, F.floor(i * F.size(c) / n).cast("int"))))
        out |= lists.select(*(cut(c).alias(c) for c in strings)).first().asDict()
    return {c: out[c] or [] for c in columns}


def ranks(df: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """The rows with _r0, _r1, ... (0 to 2**bits - 1): how many boundaries lie below each column's value, found by binary search; null is 0. A greater value never has a lower rank."""
    n = 1 << bits
    cuts, keys = boundaries(df, columns, n), [_rankable(df, c) for c in columns]
    fixed = [F.lit(cuts[c]) if cuts[c] else F.array().cast("array<string>" if keys[i][1] else "array<double>") for i, c in enumerate(columns)]
    ranked = df.select("*", *(k.alias(f"_v{i}") for i, (k, _) in enumerate(keys)), *(F.lit(0).alias(f"_r{i}") for i in range(len(columns))))
    for b in range(bits - 1, -1, -1):  # one bit of all ranks at a time
        step = 1 << b
        ranked = ranked.withColumns({f"_r{i}": F.col(f"_r{i}") + F.when(F.get(fixed[i], F.col(f"_r{i}") + (step - 1)) < F.col(f"_v{i}"), step).otherwise(0) for i in range(len(columns))})
    return ranked.drop(*(f"_v{i}" for i in range(len(columns))))


def z_ordered(df: DataFrame, columns: list[str], files: int, bits: int = 8) -> DataFrame:
    """Rows ordered along the curve of the columns' approximate ranks (strings in their own order), in ``files`` ranges. Rows of one place on the curve may be dealt to several ranges, so that a frequent value doesn't fill one."""
    z = interleaved(*(F.col(f"_r{i}") for i in range(len(columns))), bits=bits)
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    placed = ranks(df, columns, bits).select(*df.columns, z.alias("_z"), F.xxhash64(*plain).alias("_tie"))
    return placed.repartitionByRange(files, "_z", "_tie").sortWithinPartitions("_z", *columns).drop("_tie")


def admitting(table: DataFrame, predicates: dict[str, dict[str, tuple]]) -> DataFrame:
    """For predicates (column -> least and greatest value, both included) on a table that is read from files: predicate, files, and admitted, those whose values may meet it by their least and greatest alone."""
    # least <= g and greatest >= l, asked of each row: two booleans a column and bound are hashed by file, while the least and greatest of strings would need all rows of a task sorted by file
    bounds = list(dict.fromkeys(x for p in predicates.values() for c, (least, greatest) in p.items() for x in ((c, "<=", greatest), (c, ">=", least))))
    meets = {x: F.bool_or(F.col(x[0]) <= F.lit(x[2]) if x[1] == "<=" else F.col(x[0]) >= F.lit(x[2])).alias(f"_{k}") for k, x in enumerate(bounds)}
    spans = table.groupBy(F.col("_metadata.file_path").alias("_file")).agg(*(meets.values() or [F.count("*").alias("_rows")]))

    def may(p: dict[str, tuple]) -> Column:
        out = F.lit(True)
        for c, (least, greatest) in p.items():
            for x in ((c, "<=", greatest), (c, ">=", least)):
                out = out & F.col(f"_{bounds.index(x)}")
        return out

    counts = spans.agg(F.count("*").alias("files"), *(F.count_if(may(p)).alias(f"_{k}") for k, p in enumerate(predicates.values())))
    return counts.select("files", F.explode(F.array(*(F.struct(F.lit(name).alias("predicate"), F.col(f"_{k}").alias("admitted")) for k, name in enumerate(predicates)))).alias("_p")).select("_p.predicate", "files", "_p.admitted")


def sampled(df: DataFrame, stratum: str, key: str, percent: int) -> DataFrame:
    """A fixed share of each stratum: rows whose key's digest falls below it, so the sample is the same on each run."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(stratum), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(digest % 100 < percent)


def drawn(df: DataFrame, stratum: str, key: str, n: int, weight: str | None = None) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all, if it has fewer), drawn without replacement with chances by ``weight`` (equal, if none is given; rows without a positive weight are never drawn), the same on each run: those of least -ln(u) / weight, u a number between 0 and 1
    from the digest of stratum and key. Each task keeps ``n`` rows of a stratum, so a large one never meets."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(stratum), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ranked = df.where(w > 0).withColumn("_k", -F.log((digest + 0.5) / F.lit(float(1 << 32))) / w)
    return ranked.withColumn("_at", F.row_number().over(Window.partitionBy(stratum).orderBy("_k", key))).where(F.col("_at") <= n).drop("_k", "_at")


def error_rates(sample: DataFrame, stratum: str, wrong: str, z: float = 1.96) -> DataFrame:
    """stratum, n, errors, rate, and the bounds of Wilson's interval (``z`` = 1.96: 95 %) of a sample drawn with equal chances."""
    g = sample.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(F.col(wrong)).alias("errors")).withColumn("rate", F.col("errors") / F.col("n"))
    n, p = F.col("n"), F.col("rate")
    middle, reach = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.withColumn("low", F.greatest(F.lit(0.0), middle - reach)).withColumn("high", F.least(F.lit(1.0), middle + reach))
