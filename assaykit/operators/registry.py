"""Schema registry and the stores of dynamically described records."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V

FIELD_TYPE = "array<struct<name:string,type:string,required:boolean>>"


# ---- definitions --------------------------------------------------------------------------------
def definition_rows(profiled: DataFrame) -> DataFrame:
    """One row per field: type, required, constraints, indicators, statistics."""
    return profiled.select(
        "field_id", "field", F.col("detected_type").alias("type"), (F.col("null_count") == 0).alias("required"),
        F.struct("min_length", "max_length", "min_value", "max_value",
                 *(["categories"] if "categories" in profiled.columns else [])).alias("constraints"),
        F.struct("completeness", "consistency", "validity", "overall_quality").alias("quality_indicators"),
        F.struct("total_values", "unique_values", "null_count", "mean_value", "std_value").alias("statistics"))


def schema_entry(profiled: DataFrame, schema_name: str, source_type: str, created_at: Column) -> DataFrame:
    """A registry candidate: one row whose fields are as many as the table has columns."""
    field = F.struct(F.col("field").alias("name"), F.col("detected_type").alias("type"), (F.col("null_count") == 0).alias("required"))
    return profiled.agg(F.sort_array(F.collect_list(field)).alias("fields")).select(
        F.lit(schema_name).alias("schema_name"), F.lit(source_type).alias("source_type"), created_at.alias("created_at"), "fields")


def schema_hash(fields: Column) -> Column:
    """SHA-256 of the structure: the order of columns, times and statistics do not count."""
    parts = F.transform(fields, lambda f: F.concat_ws(":", f["name"], f["type"], f["required"].cast("string")))
    return F.sha2(F.array_join(F.sort_array(parts), "|"), 256)


def register(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """New registry rows for candidates whose (name, hash) is not known; versions go on from the last."""
    hashed = candidates.withColumn("schema_hash", schema_hash(F.col("fields")))
    first = hashed.groupBy("schema_name", "schema_hash").agg(  # a hash offered twice is registered once
        F.min_by(F.struct("source_type", "created_at", "fields"), "created_at").alias("entry")
    ).select("schema_name", "schema_hash", "entry.*")
    fresh = first.join(registry.select("schema_name", "schema_hash"), ["schema_name", "schema_hash"], "left_anti")
    last = registry.groupBy("schema_name").agg(F.max("schema_version").alias("last_version"))
    order = Window.partitionBy("schema_name").orderBy("created_at", "schema_hash")  # versions of one name: a handful
    return fresh.join(last, "schema_name", "left").select(
        "schema_name", (F.coalesce("last_version", F.lit(0)) + F.row_number().over(order)).cast("int").alias("schema_version"),
        "schema_hash", "source_type", "created_at", F.lit(True).alias("is_active"), "fields")


def empty_registry(spark) -> DataFrame:
    return spark.createDataFrame([], f"schema_name string, schema_version int, schema_hash string, source_type string, "
                                     f"created_at timestamp_ntz, is_active boolean, fields {FIELD_TYPE}")


# ---- comparison -----------------------------------------------------------------------------------
def fields_of(registry: DataFrame) -> DataFrame:
    return registry.select("schema_name", "schema_version", F.inline("fields")).withColumnRenamed("name", "field")


def _changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    a = old.select(*keys, F.col("type").alias("old_type"), F.col("required").alias("old_required"), F.lit(True).alias("was"))
    b = new.select(*keys, F.col("type").alias("new_type"), F.col("required").alias("new_required"), F.lit(True).alias("is"))
    kind = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when((F.col("old_type") != F.col("new_type")) | (F.col("old_required") != F.col("new_required")), "modified"))
    return a.join(b, keys, "full").withColumn("change", kind).filter(F.col("change").isNotNull()).drop("was", "is")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified fields between two ``field, type, required`` frames."""
    return _changes(old, new, ["field"]).select("field", "change")


def type_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every change with the types on both sides."""
    return _changes(old, new, ["field"]).select("field", "change", "old_type", "new_type")


def evolution(registry: DataFrame) -> DataFrame:
    """Changes of every version against the one before it."""
    order = Window.partitionBy("schema_name").orderBy("schema_version")
    steps = registry.select("schema_name", "schema_version", "fields",
                            F.lead("schema_version").over(order).alias("next_version"),
                            F.lag("schema_version").over(order).alias("previous_version"))
    old = fields_of(steps.filter(F.col("next_version").isNotNull()).select("schema_name", F.col("next_version").alias("schema_version"), "fields"))
    new = fields_of(steps.filter(F.col("previous_version").isNotNull()).select("schema_name", "schema_version", "fields"))
    rows = _changes(old, new, ["schema_name", "schema_version", "field"])
    return rows.select("schema_name", "schema_version", "field", "change", "old_type", "new_type")


def list_schemas(registry: DataFrame) -> DataFrame:
    """Active schemas, newest first."""
    return registry.filter("is_active").orderBy(F.desc("created_at"), "schema_name", F.desc("schema_version")).select(
        "schema_name", "schema_version", "schema_hash", "source_type", "created_at", F.size("fields").alias("field_count"))


def schema_info(registry: DataFrame, name: str, version: int) -> DataFrame:
    return registry.filter((F.col("schema_name") == name) & (F.col("schema_version") == version))


# ---- stores ------------------------------------------------------------------------------------------
def storage_type(kind: Column) -> Column:
    """Storage type of a semantic type; string unless the table says otherwise."""
    table = F.create_map(*[F.lit(x) for pair in V.STORAGE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("string"))


def structured_name(schema_name: str, version: int) -> str:
    return f"data_{schema_name}_{version}"


def structured(df: DataFrame, definition: dict[str, str], *, row_index: Column, job_id: str, source_file: str,
               ingestion_time: Column, status: Column, score: Column) -> DataFrame:
    """Typed columns and the seven system columns; a field named like one of them, in any case, is skipped. Values that do not fit their type become null."""
    typed = [F.col(f"`{c}`").try_cast(V.STORAGE_TYPES.get(kind, "string")).alias(c)
             for c, kind in definition.items() if c.lower() not in V.SYSTEM_COLUMNS]
    return df.select(
        F.concat_ws("-", F.lit(job_id), row_index.cast("string")).alias("id"), F.lit(job_id).alias("job_id"),
        F.lit(source_file).alias("source_file"), row_index.alias("row_index"), status.alias("validation_status"),
        score.alias("quality_score"), ingestion_time.alias("ingestion_time"), *typed)


def flexible(df: DataFrame, columns: list[str], **system: Column) -> DataFrame:
    """System columns and the record as JSON text."""
    return df.select(*[c.alias(n) for n, c in system.items()], F.to_json(F.struct(*columns)).alias("payload"))


def query_structured(df: DataFrame, filters: dict[str, Any], order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """Equality filters as literals, in a stated order. For deep pages use ``paging.seek``, as an offset gathers the rows it skips."""
    conds = [F.col(f"`{c}`") == F.lit(v) for c, v in filters.items()]
    kept = df.filter(reduce(lambda a, b: a & b, conds)) if conds else df
    return kept.orderBy(*order).offset(offset).limit(limit)


def json_text(payload: str, key: str) -> Column:
    """The value of a top-level key of JSON text, whatever characters the key has."""
    if "'" in key or "?" in key:  # a path cannot name such a key
        return F.from_json(F.col(f"`{payload}`"), "map<string,string>")[key]
    return F.get_json_object(F.col(f"`{payload}`"), f"$['{key}']")


def query_flexible(df: DataFrame, payload: str, filters: dict[str, Any], order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """Equality filters on keys of a JSON payload, compared as text."""
    conds = [json_text(payload, key) == F.lit(str(value)) for key, value in filters.items()]
    kept = df.filter(reduce(lambda a, b: a & b, conds)) if conds else df
    return kept.orderBy(*order).offset(offset).limit(limit)


def json_field_types(df: DataFrame, payload: str) -> DataFrame:
    """Type of every key of JSON objects: one pass, keys combined before the exchange."""
    from ..functions.detectors import is_date, is_datetime

    pairs = df.select(F.explode(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")).alias("field", "v"))
    kinds = pairs.select("field", F.schema_of_variant("v").alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))
    kinds = kinds.filter(F.col("kind") != "VOID")
    whole = F.col("kind").isin("BIGINT", "BOOLEAN")
    numeric = whole | F.col("kind").startswith("DECIMAL") | F.col("kind").isin("DOUBLE", "FLOAT")
    text, value = F.col("kind") == "STRING", F.col("value")
    counts = kinds.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("whole"), F.count_if(numeric).alias("numeric"),
        F.count_if(text & (is_date(value) | is_datetime(value))).alias("temporal"),
        F.count_if(text & value.contains("@") & value.contains(".")).alias("mail"),
        F.count_if(text & value.rlike(r"[+\-()]")).alias("phone"), F.count_if(F.col("kind").startswith("OBJECT")).alias("nested"))

    def all_of(c: str) -> Column:
        return F.col(c) == F.col("n")

    kind = (F.when(all_of("whole"), "integer").when(all_of("numeric"), "float").when(all_of("temporal"), "datetime")
            .when(all_of("mail"), "email").when(all_of("nested"), "json").when(all_of("phone"), "phone").otherwise("string"))
    return counts.select("field", kind.alias("type"), F.col("n").alias("values"))
