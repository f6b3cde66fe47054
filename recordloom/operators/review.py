"""Human review: queue, corrections, verification, commit gate and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.schemas import few, judged, required_paths

STATES = ["uploading", "uploaded", "partitioned", "extracting", "review", "committed", "failed"]


def queue(fields: DataFrame) -> DataFrame:
    """Fields with their place in the document's review: least confident first, unknown confidence before all."""
    return fields.withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("confidence").asc_nulls_first(), "path")))


def band(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def corrected(fields: DataFrame, corrections: DataFrame, props: DataFrame | None = None) -> DataFrame:
    """Fields after the last correction (document_id, path, new_value, corrected_by, corrected_at) of each: corrected_from keeps the old value.
    With ``props`` (and the fields' schema_name, schema_version) corrected values are judged again: validation_error is the keyword that they break, or null."""
    key = ["document_id", "path"]
    last = corrections.groupBy(*key).agg(F.max(F.struct("corrected_at", "corrected_by", "new_value")).alias("_c"))
    joined = fields.join(last, key, "left")
    hit = F.col("_c").isNotNull()
    out = joined.select(
        *key, *(c for c in fields.columns if c not in (*key, "value", "corrected_from", "corrected_by", "corrected_at")), F.when(hit, F.col("_c.new_value")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.col("value")).alias("corrected_from"), F.col("_c.corrected_by").alias("corrected_by"), F.col("_c.corrected_at").alias("corrected_at"), hit.alias("_hit"),
    )
    if props is None:
        return out.drop("_hit")
    was = F.col("validation_error") if "validation_error" in fields.columns else F.lit(None).cast("string")
    again = judged(out.withColumn("_was", was), props)
    return again.withColumn("validation_error", F.when(F.col("_hit"), F.col("keyword")).otherwise(F.col("_was"))).drop("_hit", "_was", "keyword", "_known")


def correction_log(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every correction in its field's order: document_id, path, step (from 1), old_value, new_value, corrected_by, corrected_at. Corrections of fields that aren't there are left out."""
    w = Window.partitionBy("document_id", "path").orderBy("corrected_at", "corrected_by", "new_value")
    step = F.row_number().over(w)
    steps = corrections.join(fields.select("document_id", "path", F.col("value").alias("_first")), ["document_id", "path"])
    return steps.select("document_id", "path", step.alias("step"), F.when(step == 1, F.col("_first")).otherwise(F.lag("new_value").over(w)).alias("old_value"), "new_value", "corrected_by", "corrected_at")


def verified(fields: DataFrame, paths: DataFrame) -> DataFrame:
    """Fields with ``verified`` set for the given (document_id, path)."""
    marks = paths.select("document_id", "path").distinct().withColumn("_v", F.lit(True))
    was = F.coalesce(F.col("verified"), F.lit(False)) if "verified" in fields.columns else F.lit(False)
    return fields.join(marks, ["document_id", "path"], "left").withColumn("verified", was | F.col("_v").isNotNull()).drop("_v")


def coverage(documents: DataFrame, fields: DataFrame, props: DataFrame) -> DataFrame:
    """document_id, path, status of each required property: missing, unverified or ok."""
    need = required_paths(documents, fields, props)
    have = fields.select("document_id", "path", F.coalesce("verified", F.lit(False)).alias("_v"))
    return need.join(have, ["document_id", "path"], "left").select("document_id", "path", F.when(F.col("_v").isNull(), "missing").when(~F.col("_v"), "unverified").otherwise("ok").alias("status"))


def _around(path: Column) -> Column:
    """The paths of the objects that a path goes through, the top left out."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def path_collisions(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the fields that hold a value where another field's path goes on: no object can have both."""
    inner = fields.select(*keys, F.explode(_around(F.col("path"))).alias("path")).distinct()
    return fields.select(*keys, "path").join(inner, [*keys, "path"], "left_semi")


def gate_errors(documents: DataFrame, fields: DataFrame, props: DataFrame) -> DataFrame:
    """document_id, path, error: why a document can't be committed. Fields (one for each document_id, path) are read once and dealt by document; a row holds the paths of a document, not the values, and all four kinds of errors come from it.
    Fields of documents that aren't in ``documents`` keep their own errors; a document without fields lacks all that its schema requires."""
    key = ["schema_name", "schema_version"]
    typed = fields.join(documents.select("document_id", *key), "document_id", "left")
    paths = lambda when: F.collect_list(F.when(when, F.col("path")))
    found = judged(typed, props).groupBy("document_id").agg(
        F.collect_list("path").alias("_paths"), paths(F.col("verified")).alias("_verified"), paths(F.col("validation_error").isNotNull()).alias("_marked"), paths(F.col("schema_name").isNotNull() & F.col("keyword").isNotNull()).alias("_broken"),
        paths(F.instr(F.substr("path", F.lit(2)), "/") > 0).alias("_deep"),
    )
    need = props.where("required").groupBy(F.col("name").alias("schema_name"), F.col("version").alias("schema_version")).agg(F.collect_list(F.struct("path", "parent")).alias("_need"))
    rows = documents.select("document_id", *key, (F.col("state").isNull() | (F.col("state") != "review")).alias("_early")).join(found, "document_id", "full_outer").join(F.broadcast(need) if few(props) else need, key, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_paths", "_verified", "_marked", "_broken", "_deep")} | {"_need": F.coalesce("_need", F.array().cast("array<struct<path:string,parent:string>>"))})
    rows = rows.withColumn("_through", F.array_distinct(F.flatten(F.transform("_deep", _around))))
    # what an inner object requires counts where the document has something in it
    inside = F.array_intersect(F.transform("_need", lambda x: x["parent"]), F.col("_through"))
    rows = rows.withColumn("_need", F.transform(F.filter("_need", lambda x: (x["parent"] == "") | F.array_contains(inside, x["parent"])), lambda x: x["path"]))
    named = lambda found, error: F.transform(found, lambda p: F.struct(p.alias("path"), F.lit(error).alias("error")))
    errors = F.concat(
        F.when(F.col("_early"), F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit("invalid_state").alias("error")))).otherwise(F.array().cast("array<struct<path:string,error:string>>")),
        named(F.array_except("_need", "_paths"), "missing_required"), named(F.array_except(F.array_intersect("_need", "_paths"), "_verified"), "unverified_required"),
        named(F.col("_marked"), "validation_error"), named(F.col("_broken"), "schema_validation"), named(F.array_intersect("_paths", "_through"), "path_collision"),
    )
    return rows.select("document_id", F.inline(errors))


def committable(documents: DataFrame, errors: DataFrame) -> DataFrame:
    return documents.join(errors.select("document_id").distinct(), "document_id", "left_anti")


def nested_json(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, data: a JSON object for each document, built from its pointer paths bottom-up, as deep as they go; of equal paths the least value stays. Fields of ``path_collisions`` give way to the object at their place."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    depth = fields.agg(F.max(F.size(parts))).first()[0] or 1
    leaves = fields.select(*keys, parts.alias("_p"), F.to_json(F.struct(F.col("value").alias("v")), {"ignoreNullFields": "false"}).alias("_j"))
    leaves = leaves.select(*keys, "_p", F.lit(1).alias("_leaf"), F.expr("substring(_j, 6, length(_j) - 6)").alias("_j"))
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    made = None
    for d in range(depth, 0, -1):
        level = leaves.where(F.size("_p") == d)
        level = (level if made is None else level.unionByName(made)).withColumn("_n", F.element_at("_p", d)).withColumn("_up", F.slice("_p", 1, d - 1))
        one = level.groupBy(*keys, "_up", "_n").agg(F.min(F.struct("_leaf", "_j"))["_j"].alias("_j"))
        made = one.withColumn("_e", F.concat(quoted("_n"), F.lit(":"), "_j")).groupBy(*keys, F.col("_up").alias("_p")).agg(F.lit(0).alias("_leaf"), F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("_e")), ","), F.lit("}")).alias("_j"))
    return made.select(*keys, F.col("_j").alias("data"))


def exported(documents: DataFrame, fields: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """document_id, line: committed documents (of those in ``only``, document_id, if given) as NDJSON lines of data and _metadata."""
    done = documents.where("state = 'committed'")
    if only is not None:
        done = done.join(only.select("document_id").distinct(), "document_id", "left_semi")
    data = nested_json(fields.join(done.select("document_id"), "document_id", "left_semi"), ["document_id"])
    meta = F.to_json(F.struct("document_id", "schema_name", "schema_version"))
    return done.join(data, "document_id", "left").select("document_id", F.concat(F.lit('{"_metadata":'), meta, F.lit(',"data":'), F.coalesce("data", F.lit("{}")), F.lit("}")).alias("line"))


def latest_state(changes: DataFrame) -> DataFrame:
    """document_id, state after its last change."""
    return changes.groupBy("document_id").agg(F.max_by("state", F.struct("ts", "state")).alias("state"))


def bad_transitions(changes: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Changes (document_id, state, ts) that go back in the order of states (failing is always allowed), or to or from a state that isn't one."""
    place = F.array_position(F.array(*map(F.lit, states)), F.col("state"))
    before = F.lag("_at").over(Window.partitionBy("document_id").orderBy("ts", "state"))
    back = (F.col("_at") < F.col("_before")) & (F.col("state") != "failed")
    return changes.withColumn("_at", place).withColumn("_before", before).where(back | (F.col("_at") == 0)).drop("_at", "_before")


def provenance(fields: DataFrame, partitions: DataFrame) -> DataFrame:
    """document_id, path, value and where it was read: kind, page, bbox of its source partition (document_id, partition_id); partition_known is false where that isn't there."""
    p = partitions.select("document_id", F.col("partition_id").alias("source_partition_id"), "kind", "page", "bbox", F.lit(True).alias("_known"))
    return fields.join(p, ["document_id", "source_partition_id"], "left").select("document_id", "path", "value", "kind", "page", "bbox", F.coalesce("_known", F.lit(False)).alias("partition_known"))


def document_detail(documents: DataFrame, partitions: DataFrame, fields: DataFrame) -> DataFrame:
    """Each document with its partitions by ordinal (content as its length) and its fields by confidence, unknown first."""
    p = partitions.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", F.length("content").alias("length")))).alias("partitions"))
    f = fields.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("_order"), "path", "value", "confidence"))).alias("fields"))
    return documents.join(p, "document_id", "left").join(f, "document_id", "left")


def upload_parts(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """document_id, part_number, status of planned parts: completed or missing."""
    s = stored.select("document_id", "part_number").distinct().withColumn("_s", F.lit(True))
    return plan.select("document_id", "part_number").join(s, ["document_id", "part_number"], "left").select("document_id", "part_number", F.when(F.col("_s"), "completed").otherwise("missing").alias("status"))


def encrypted(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Values encrypted by AES-GCM with each document's data key (document_id, data_key binary)."""
    return fields.join(keys, "document_id").withColumn("value", F.aes_encrypt(F.col("value").cast("binary"), F.col("data_key"), F.lit("GCM"))).drop("data_key")


def decrypted(fields: DataFrame, keys: DataFrame) -> DataFrame:
    return fields.join(keys, "document_id").withColumn("value", F.aes_decrypt("value", "data_key", F.lit("GCM")).cast("string")).drop("data_key")
