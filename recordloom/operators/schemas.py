"""Versioned record schemas as a property table, validation of fields against it, and typed coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.values import to_array, to_boolean, to_integer, to_number

TYPES = ["string", "integer", "number", "boolean", "array", "object", "null"]


def latest_per_name(schemas: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The row of the highest version of each name; an aggregate, so no name gathers its versions in one place."""
    rest = [c for c in schemas.columns if c not in (name, version)]
    return schemas.groupBy(name).agg(F.max(F.struct(version, *rest)).alias("_r")).select(name, F.col(f"_r.{version}").alias(version), *(F.col(f"_r.{c}").alias(c) for c in rest))


def registered(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Incoming (name, ...) with the versions they get: after the latest, or from 1."""
    last = existing.groupBy("name").agg(F.max("version").alias("_last"))
    k = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return incoming.join(last, "name", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + k).drop("_last")


_KEYWORDS = "struct<type:string,enum:array<string>,minimum:double,maximum:double,pattern:string,minLength:int,maxLength:int,format:string,required:array<string>,additionalProperties:boolean,properties:map<string,string>>"


def properties(schemas: DataFrame, body: str = "body") -> DataFrame:
    """The keywords of each property, of nested ones too: name, version, path, parent (the path of the object around it, "" at the top), type (as written), types, required, enum, minimum, maximum, pattern, min_length, max_length, format;
    open (whether the object admits members that it doesn't list) and additional (whether the one around it does). The top admits none unless it says so, inner objects all unless they say not. Objects are walked level by level, as deep as the schemas go."""
    level = schemas.select("name", "version", F.lit("").alias("parent"), F.from_json(body, _KEYWORDS).alias("s"), F.lit(False).alias("_default"))
    out = None
    while out is None or level.where(F.size("s.properties") > 0).limit(1).count():
        p = level.select("name", "version", "parent", F.explode("s.properties").alias("k", "j"), F.col("s.required").alias("_r"), F.coalesce("s.additionalProperties", "_default").alias("additional"))
        p = p.withColumn("p", F.from_json("j", _KEYWORDS)).withColumn("path", F.concat_ws("/", "parent", "k"))
        types = F.when(F.col("p.type").startswith("["), F.from_json("p.type", "array<string>")).when(F.col("p.type").isNotNull(), F.array("p.type"))
        rows = p.select(
            "name", "version", "path", "parent", "p.type", types.alias("types"), F.coalesce(F.array_contains("_r", F.col("k")), F.lit(False)).alias("required"), "p.enum", "p.minimum", "p.maximum", "p.pattern",
            F.col("p.minLength").alias("min_length"), F.col("p.maxLength").alias("max_length"), "p.format", F.coalesce("p.additionalProperties", F.lit(True)).alias("open"), "additional",
        )
        out = rows if out is None else out.unionByName(rows)
        level = p.select("name", "version", F.col("path").alias("parent"), F.col("p").alias("s"), F.lit(True).alias("_default")).where("s.properties is not null")
    return out


def compiles(pattern: Column) -> Column:
    """Whether a pattern is one that ``rlike`` takes; null has none to judge."""
    return F.when(pattern.isNotNull(), F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull())


def malformed(props: DataFrame) -> DataFrame:
    """Properties whose keywords can't hold, with reasons: unknown types, crossed bounds, and patterns that don't compile (each distinct one is judged once)."""
    unknown = F.exists("types", lambda x: ~x.isin(TYPES))
    judged_patterns = props.where("pattern is not null").select("pattern").distinct().select(F.col("pattern").alias("_pattern"), compiles(F.col("pattern")).alias("_compiles"))
    said = F.array_compact(F.array(
        F.when(unknown, "type"), F.when(F.col("minimum") > F.col("maximum"), "minimum"), F.when(F.col("min_length") > F.col("max_length"), "minLength"), F.when(~F.col("_compiles"), "pattern"),
    ))
    return props.join(judged_patterns, F.col("pattern") == F.col("_pattern"), "left").withColumn("reasons", said).where(F.size("reasons") > 0).drop("_pattern", "_compiles")


def _fits(value: Column, kind: Column) -> Column:
    """Whether a value's text can be of a type."""
    number = value.try_cast("double")
    shape = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(value.isNull(), kind == "null").when(kind == "string", F.lit(True)).when(kind == "integer", value.rlike("^[+-]?[0-9]+(\\.0*)?$")).when(kind == "number", number.isNotNull() & value.rlike("^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"))
        .when(kind == "boolean", value.isin("true", "false")).when(kind == "array", F.coalesce(shape.startswith("ARRAY"), F.lit(False))).when(kind == "object", F.coalesce(shape.startswith("OBJECT"), F.lit(False))).otherwise(False)
    )


def first_error(value: Column) -> Column:
    """The first keyword that a value breaks, null if none; columns of ``properties`` stand beside it, and bad_pattern, whether theirs doesn't compile (pattern is null then). A null value has the type null. Bounds hold for numbers, patterns and lengths for strings. Format is not asserted."""
    number = F.when(F.col("types").isNull() | F.arrays_overlap("types", F.array(F.lit("integer"), F.lit("number"))), value.try_cast("double"))
    text = F.when(F.col("types").isNull() | F.array_contains("types", "string"), value)
    fits = F.when(F.size("types") == 1, _fits(value, F.get("types", F.lit(0)))).otherwise(F.exists("types", lambda k: _fits(value, k)))  # one type is the rule, and compiled
    return (
        F.when(F.col("types").isNotNull() & ~fits, "type").when(F.col("enum").isNotNull() & value.isNotNull() & ~F.array_contains("enum", value), "enum")
        .when(number < F.col("minimum"), "minimum").when(number > F.col("maximum"), "maximum")
        .when(F.length(text) < F.col("min_length"), "minLength").when(F.length(text) > F.col("max_length"), "maxLength").when(F.col("bad_pattern") & text.isNotNull(), "malformedPattern").when(~F.rlike(text, F.col("pattern")), "pattern")
    )


_CHECKED = ["types", "enum", "minimum", "maximum", "pattern", "bad_pattern", "min_length", "max_length"]


#: Properties up to which a registry is sent to all tasks; a larger one is joined by shuffles.
BROADCAST_PROPERTIES = 20_000


def by_shuffle(df: DataFrame) -> DataFrame:
    """For a join: a table that grows with the input is never sent to all tasks through the driver, however small its compressed files or its estimate are."""
    return df.hint("merge")


def few(props: DataFrame) -> bool:
    return props.limit(BROADCAST_PROPERTIES + 1).count() <= BROADCAST_PROPERTIES


def judged(fields: DataFrame, props: DataFrame) -> DataFrame:
    """Fields (document_id, schema_name, schema_version, path, value) with keyword: what they break (additionalProperties if there is no such property and the object around it admits no others; malformedPattern for strings of a property whose pattern doesn't compile), null if nothing."""
    key = ["schema_name", "schema_version"]
    named = props.withColumnsRenamed({"name": "schema_name", "version": "schema_version"}).withColumn("bad_pattern", F.coalesce(~compiles(F.col("pattern")), F.lit(False))).withColumn("pattern", F.when(~F.col("bad_pattern"), F.col("pattern")))
    known = named.select(*key, "path", *(F.col(c).alias(f"_p_{c}") for c in _CHECKED), F.lit(True).alias("_known"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # an unlisted path is for the nearest object around it that is listed (the top is) to admit
    if few(props):
        around = named.groupBy(*key).agg(F.collect_set("path").alias("_paths"), F.array_union(F.collect_set(F.when(F.col("open"), F.col("path"))), F.collect_set(F.when(F.col("additional") & (F.col("parent") == ""), F.lit("")))).alias("_open"))
        nearest = F.get(F.filter(ancestors, lambda x: (x == "") | F.array_contains("_paths", x)), F.lit(0))
        joined = fields.join(F.broadcast(known), [*key, "path"], "left").join(F.broadcast(around), key, "left").withColumn("_admits", F.array_contains("_open", nearest))
    else:
        # a large registry: what admits each distinct unlisted path is found once, by joins
        listed = named.select(*key, F.col("path").alias("_around"), "open").unionByName(named.where("parent = ''").groupBy(*key).agg(F.max("additional").alias("open")).withColumn("_around", F.lit("")))
        unlisted = fields.select(*key, "path").distinct().join(by_shuffle(known.select(*key, "path")), [*key, "path"], "left_anti")
        nearest = unlisted.select(*key, "path", F.posexplode(ancestors).alias("_up", "_around")).join(by_shuffle(listed), [*key, "_around"]).groupBy(*key, "path").agg(F.min_by("open", "_up").alias("_admits"))
        joined = fields.join(by_shuffle(known), [*key, "path"], "left").join(by_shuffle(nearest), [*key, "path"], "left")
    error = F.when(F.col("_known").isNull(), F.when(~F.coalesce("_admits", F.lit(False)), "additionalProperties")).otherwise(first_error(F.col("value")))
    # the keywords stand under their own names while they are judged
    return joined.select(*fields.columns, "_known", "_admits", *(F.col(f"_p_{c}").alias(c) for c in _CHECKED)).withColumn("keyword", error).select(*fields.columns, "keyword", "_known")


def field_errors(fields: DataFrame, props: DataFrame) -> DataFrame:
    """document_id, path, keyword, message of the fields that break their property or have none."""
    bad = judged(fields, props).where("keyword is not null")
    return bad.select("document_id", "path", "keyword", F.when(F.col("_known").isNull(), F.format_string("Field '%s' not found in schema", "path")).otherwise(F.format_string("'%s' breaks %s", F.coalesce("value", F.lit("null")), "keyword")).alias("message"))


def required_paths(documents: DataFrame, fields: DataFrame, props: DataFrame) -> DataFrame:
    """document_id, path of the required properties of each document; those of an inner object only where the document has something in it."""
    need = props.where("required").select(F.col("name").alias("schema_name"), F.col("version").alias("schema_version"), "path", "parent")
    all_ = documents.join(F.broadcast(need) if few(need) else by_shuffle(need), ["schema_name", "schema_version"]).select("document_id", "path", "parent")
    if not need.where("parent <> ''").limit(1).count():
        return all_.select("document_id", "path")
    parts = F.split("path", "/")
    around = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = fields.where(F.size(parts) > 2).select("document_id", F.explode(around).alias("parent")).distinct()
    return all_.where("parent = ''").unionByName(all_.where("parent <> ''").join(by_shuffle(inside), ["document_id", "parent"], "left_semi").select(*all_.columns)).select("document_id", "path")


def missing_required(documents: DataFrame, fields: DataFrame, props: DataFrame) -> DataFrame:
    """document_id, path of required properties without a value (an inner object has one if something in it has)."""
    parts = F.split("path", "/")
    have = fields.where("value is not null").select("document_id", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    return required_paths(documents, fields, props).join(by_shuffle(have), ["document_id", "path"], "left_anti")


def coerced(value: Column, type_: Column) -> Column:
    """The value as JSON text of its type; what can't be coerced stays."""
    return (
        F.when(type_ == "integer", F.coalesce(to_integer(value).cast("string"), value)).when(type_ == "number", F.coalesce(to_number(value).cast("string"), value))
        .when(type_ == "boolean", F.coalesce(to_boolean(value).cast("string"), value)).when(type_ == "array", F.to_json(to_array(value))).otherwise(value)
    )
