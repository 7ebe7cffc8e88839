"""Queries: schema registry, comparisons, dynamic stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import paging
from ..operators import profile as P
from ..operators import registry as S
from ..operators import rules as R
from ..operators import checks as K
from ..operators import stored_profile as T
from ..operators import versions as N
from ..session import work_path
from ..sources.tables import Tables
from . import fixtures as X
from .catalog import query
from .ctes import NOW, block, with_blocks
from .q_profile import _EVENT_COLUMNS, _NUM, _near as near, _ORDER_COLUMNS, _SCORES, _SCORES_SQL, events_text, orders_text, rounded

# ---- inferred definitions ---------------------------------------------------------------------
_DEF_SQL = f"""SELECT field, detected_type AS type, null_count = 0 AS required, CAST(min_length AS INTEGER) AS min_length, CAST(max_length AS INTEGER) AS max_length,
    round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, {_SCORES_SQL}, total_values::BIGINT AS total_values, unique_values,
    null_count::BIGINT AS null_count, round(mean_value, 6) AS mean_value, round(std_value, 6) AS std_value"""


@query(with_blocks(["dprof"], f"{_DEF_SQL} FROM dprof"))
def infer_definition(spark, sf_dir):
    rows = S.definition_rows(P.profile(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS))
    flat = rows.select("field", "type", "required", "constraints.*", "quality_indicators.*", "statistics.*")
    return rounded(flat, *_NUM, *_SCORES)


# ---- three versions of the customer schema --------------------------------------------------------
V1, V2, V3 = ["name", "segment", "email"], ["name", "segment", "email", "phone", "balance"], ["name", "segment", "phone", "balance", "metro"]


def _version(spark, sf_dir, n):
    """Version 1 and 2 come from the sound rows, version 3 from all of them with another phone format."""
    if n < 3:
        return P.profile(X.train(spark, sf_dir), V1 if n == 1 else V2)
    return P.profile(X.cleaned(spark, sf_dir).drop("phone").withColumnRenamed("zip", "phone"), V3)


def _plain(rows):
    return rows.select("field", F.col("detected_type").alias("type"), (F.col("null_count") == 0).alias("required"))


def _names(fields):
    return "(" + ", ".join(f"'{f}'" for f in fields) + ")"


block("v1", f"SELECT field, detected_type AS type, null_count = 0 AS required FROM tprof WHERE field IN {_names(V1)}", ["tprof"])
block("v2", f"SELECT field, detected_type AS type, null_count = 0 AS required FROM tprof WHERE field IN {_names(V2)}", ["tprof"])
block("v3", f"""SELECT CASE WHEN field = 'zip' THEN 'phone' ELSE field END AS field, detected_type AS type, null_count = 0 AS required
    FROM dprof WHERE field IN {_names([f for f in V3 if f != 'phone'] + ['zip'])}""", ["dprof"])
block("vorders", "SELECT field, detected_type AS type, null_count = 0 AS required FROM oprof", ["oprof"])
_HASH = "sha256(string_agg(field || ':' || type || ':' || required, '|' ORDER BY field || ':' || type || ':' || required))"


@query(with_blocks(["v1", "v2", "v3", "vorders"], " UNION ALL ".join(
    f"SELECT '{n}' AS schema_name, {_HASH} AS schema_hash, count(*) AS field_count FROM {n}" for n in ("v1", "v2", "v3", "vorders"))))
def schema_hash(spark, sf_dir):
    frames = [(f"v{n}", _version(spark, sf_dir, n)) for n in (1, 2, 3)] + [("vorders", P.profile(orders_text(spark, sf_dir), _ORDER_COLUMNS))]
    out = None
    for name, rows in frames:
        one = S.schema_entry(rows, name, "file", X.now()).select(
            "schema_name", S.schema_hash(F.col("fields")).alias("schema_hash"), F.size("fields").cast("long").alias("field_count"))
        out = one if out is None else out.unionByName(one)
    return out


def _entries(spark, sf_dir):
    def entry(rows, name, source, day):
        return S.schema_entry(rows, name, source, F.lit(f"2001-07-{day:02d} 00:00:00").cast("timestamp_ntz"))

    # each table is profiled once, in one job, and registered from the kept rows; version 1 is a part of version 2
    profiles = {"v2": _version(spark, sf_dir, 2), "v3": _version(spark, sf_dir, 3), "orders": P.profile(orders_text(spark, sf_dir), _ORDER_COLUMNS),
                "events": P.profile(events_text(spark, sf_dir), _EVENT_COLUMNS)}
    path = work_path(spark, "profiles")
    reduce(lambda a, b: a.unionByName(b), [rows.withColumn("__of", F.lit(name)) for name, rows in profiles.items()]).write.parquet(path)
    kept = spark.read.parquet(path)
    p = {name: kept.filter(F.col("__of") == name).drop("__of") for name in profiles}
    v = [p["v2"].filter(F.col("field").isin(V1)), p["v2"], p["v3"]]
    known = entry(v[0], "customers", "file", 1).unionByName(entry(p["orders"], "orders", "api", 2))
    offered = (entry(v[0], "customers", "file", 5).unionByName(entry(v[1], "customers", "file", 6))
               .unionByName(entry(v[2], "customers", "stream", 7))
               .unionByName(entry(p["events"], "events", "stream", 8)))
    return known, offered


def _registry(spark, sf_dir):
    """Both rounds of registration. The registry is small and read often, so it is kept as a table."""
    path = work_path(spark, "registry")
    known, offered = _entries(spark, sf_dir)
    S.register(S.empty_registry(spark), known).write.parquet(path + "/round=1")
    first = spark.read.parquet(path + "/round=1")
    S.register(first, offered).write.parquet(path + "/round=2")
    return first, spark.read.parquet(path + "/round=2")


def _row(name, version, view, source, day):
    return (f"SELECT '{name}' AS schema_name, CAST({version} AS INTEGER) AS schema_version, {_HASH} AS schema_hash, '{source}' AS source_type, "
            f"TIMESTAMP '2001-07-{day:02d} 00:00:00' AS created_at, CAST(count(*) AS INTEGER) AS field_count FROM {view}")


block("vevents", "SELECT field, detected_type AS type, null_count = 0 AS required FROM eprof", ["eprof"])
_NEW = [_row("customers", 2, "v2", "file", 6), _row("customers", 3, "v3", "stream", 7), _row("events", 1, "vevents", "stream", 8)]
_OLD = [_row("customers", 1, "v1", "file", 1), _row("orders", 1, "vorders", "api", 2)]
block("new_schemas", " UNION ALL ".join(_NEW), ["v2", "v3", "vevents"])
block("all_schemas", " UNION ALL ".join(_OLD + _NEW), ["v1", "vorders", "v2", "v3", "vevents"])
_LISTED = ["schema_name", "schema_version", "schema_hash", "source_type", "created_at", "field_count"]


@query(with_blocks(["new_schemas"], "SELECT * FROM new_schemas"))
def register_schema(spark, sf_dir):
    """A known structure keeps its row; two new ones continue the versions; a new name starts at one."""
    _, second = _registry(spark, sf_dir)
    return second.withColumn("field_count", F.size("fields")).select(*_LISTED)


@query(with_blocks(["v2", "v3"], """
    SELECT field, CASE WHEN a.type IS NULL THEN 'added' WHEN b.type IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM v2 a FULL JOIN v3 b USING (field) WHERE a.type IS NULL OR b.type IS NULL OR a.type <> b.type OR a.required <> b.required"""))
def schema_diff(spark, sf_dir):
    return S.diff(_plain(_version(spark, sf_dir, 2)), _plain(_version(spark, sf_dir, 3)))


@query(with_blocks(["v2", "v3"], """
    SELECT field, CASE WHEN a.type IS NULL THEN 'added' WHEN b.type IS NULL THEN 'removed' ELSE 'modified' END AS change, a.type AS old_type, b.type AS new_type
    FROM v2 a FULL JOIN v3 b USING (field) WHERE a.type IS NULL OR b.type IS NULL OR a.type <> b.type OR a.required <> b.required"""))
def schema_type_changes(spark, sf_dir):
    return S.type_changes(_plain(_version(spark, sf_dir, 2)), _plain(_version(spark, sf_dir, 3)))


def _step(old, new, n):
    return f"""SELECT 'customers' AS schema_name, CAST({n} AS INTEGER) AS schema_version, field,
        CASE WHEN a.type IS NULL THEN 'added' WHEN b.type IS NULL THEN 'removed' ELSE 'modified' END AS change, a.type AS old_type, b.type AS new_type
        FROM {old} a FULL JOIN {new} b USING (field) WHERE a.type IS NULL OR b.type IS NULL OR a.type <> b.type OR a.required <> b.required"""


@query(with_blocks(["v1", "v2", "v3"], _step("v1", "v2", 2) + " UNION ALL " + _step("v2", "v3", 3)))
def schema_evolution(spark, sf_dir):
    first, second = _registry(spark, sf_dir)
    return S.evolution(first.unionByName(second))


@query(with_blocks(["all_schemas"], "SELECT * FROM all_schemas WHERE NOT (schema_name = 'customers' AND schema_version = 1)"))
def list_schemas(spark, sf_dir):
    first, second = _registry(spark, sf_dir)
    old = (F.col("schema_name") == "customers") & (F.col("schema_version") == 1)
    return S.list_schemas(first.unionByName(second).withColumn("is_active", ~old))


@query(with_blocks(["v3"], "SELECT 'customers' AS schema_name, CAST(3 AS INTEGER) AS schema_version, field, type, required FROM v3"))
def schema_info(spark, sf_dir):
    first, second = _registry(spark, sf_dir)
    return S.fields_of(S.schema_info(first.unionByName(second), "customers", 3))


# ---- stores -------------------------------------------------------------------------------------------
_STORED = {"name": "string", "email": "email", "balance": "float", "zip": "integer", "metro": "boolean"}


def _store(spark, sf_dir):
    path = work_path(spark, S.structured_name("customers", 2))
    status = F.when(F.col("name").isNull(), "invalid").otherwise("valid")
    S.structured(
        X.cleaned(spark, sf_dir), _STORED, row_index=F.col("cust_key"), job_id="job-7", source_file="customers.csv",
        ingestion_time=X.now(), status=status, score=F.when(F.col("name").isNull(), 0.5).otherwise(1.0),
    ).write.parquet(path)
    return spark.read.parquet(path)


block("stored", f"""
    SELECT 'job-7-' || cust_key AS id, 'customers.csv' AS source_file, TIMESTAMP '{NOW}' AS ingestion_time, 'job-7' AS job_id, cust_key AS row_index,
           CASE WHEN name IS NULL THEN 'invalid' ELSE 'valid' END AS validation_status, CAST(CASE WHEN name IS NULL THEN 0.5 ELSE 1.0 END AS DOUBLE) AS quality_score,
           name, email, TRY_CAST(balance AS DOUBLE) AS balance, TRY_CAST(zip AS BIGINT) AS zip,
           CASE lower(metro) WHEN 'true' THEN true WHEN 'y' THEN true WHEN 'no' THEN false END AS metro FROM cleaned""", ["cleaned"])


@query(with_blocks(["stored"], "SELECT * FROM stored"))
def store_structured(spark, sf_dir):
    return _store(spark, sf_dir)


@query(with_blocks(["stored"], "SELECT id, name, balance, zip FROM stored WHERE validation_status = 'valid' AND metro = true ORDER BY row_index LIMIT 50 OFFSET 25"))
def query_structured(spark, sf_dir):
    rows = S.query_structured(_store(spark, sf_dir), {"validation_status": "valid", "metro": True}, ["row_index"], 50, 25)
    return rows.select("id", "name", "balance", "zip")


@query(with_blocks(["cleaned"], "SELECT 'job-8' AS job_id, cust_key AS row_index, name, email, balance FROM cleaned"))
def store_flexible(spark, sf_dir):
    """Stored as JSON text and read back out of it."""
    path = work_path(spark, "flexible")
    S.flexible(X.cleaned(spark, sf_dir), ["name", "email", "balance"], job_id=F.lit("job-8"), row_index=F.col("cust_key")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("job_id", "row_index", F.from_json("payload", "name string, email string, balance string").alias("r")).select("job_id", "row_index", "r.*")


@query("SELECT event_id, event_type, props FROM events WHERE json_extract_string(props, '$.k') = '69' ORDER BY event_id LIMIT 100 OFFSET 10")
def query_flexible(spark, sf_dir):
    rows = S.query_flexible(X.read_table(spark, sf_dir, "events"), "props", {"k": 69}, ["event_id"], 100, 10)
    return rows.select("event_id", "event_type", "props")


block("con_stats", "SELECT count(*) AS total_records, count(*) FILTER (WHERE error_count = 0) AS valid_records, round(avg(quality_score), 6) AS average_quality_score FROM con", ["con"])


@query(with_blocks(["con_stats", "con", "tprof"], """
    SELECT 'customers_file' AS schema_name, CAST(1 AS INTEGER) AS schema_version, total_records, valid_records, average_quality_score,
           (SELECT count(*) FROM tprof) AS field_count, total_records AS stored_records, round((SELECT count(*) FILTER (WHERE error_count > 0) / count(*) FROM con), 6) AS error_rate FROM con_stats"""))
def dynamic_process(spark, sf_dir):
    """Infer, register, validate, store and measure."""
    sound = X.train(spark, sf_dir)
    definition = R.learn_definition(sound, X.DIRTY_FIELDS)
    entry = S.register(S.empty_registry(spark), S.schema_entry(P.profile(sound, X.DIRTY_FIELDS), "customers_file", "file", X.now()))
    path = work_path(spark, "dynamic")
    checked = K.validate_constraints(X.cleaned(spark, sf_dir), definition)
    checked.select(F.col("cust_key").alias("row_index"), "status", "quality_score", "is_valid", "errors", "warnings", *X.DIRTY_FIELDS).write.parquet(path)
    stored = spark.read.parquet(path)
    metrics = K.dynamic_metrics(stored, X.DIRTY_FIELDS).select("error_rate")
    summary = stored.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_valid").alias("valid_records"),
                         F.round(F.avg("quality_score"), 6).alias("average_quality_score"), F.count("row_index").alias("stored_records"))
    names = entry.select("schema_name", "schema_version", F.size("fields").cast("long").alias("field_count"))
    return names.crossJoin(summary).crossJoin(rounded(metrics, "error_rate"))  # three frames of one row


@query(with_blocks(["cleaned"], """
    SELECT 1 AS version, cust_key, name, email, NULL AS phone, NULL AS balance FROM cleaned UNION ALL SELECT 2, cust_key, name, email, phone, NULL FROM cleaned
    UNION ALL SELECT 3, cust_key, name, NULL, phone, balance FROM cleaned"""))
def read_all_versions(spark, sf_dir):
    """One folder per version, read as one table with the union of their columns."""
    path, df = work_path(spark, "versions"), X.cleaned(spark, sf_dir)
    for version, columns in ((1, ["name", "email"]), (2, ["name", "email", "phone"]), (3, ["name", "phone", "balance"])):
        df.select("cust_key", *columns).write.parquet(f"{path}/version={version}")
    return spark.read.option("mergeSchema", "true").parquet(path)


# JSON records of orders: text, numbers, dates, a nested object and mixed values
_JSON = """concat('{"id": ', k, ', "price": ', p, ', "flag": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, ', "mail": "u', k, '@x.example.com", "placed": "', d,
    '", "tel": "+1-555-', k, '", "place": {"zip": ', k % 100, '}, "mixed": ', CASE WHEN k % 2 = 0 THEN '"a"' ELSE '1' END, ', "note": "n', k, '"', CASE WHEN k % 3 = 0 THEN ', "extra": 1.5' ELSE '' END, '}')"""
block("json_records", f"""SELECT k, {_JSON} AS payload FROM (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")


def json_records(spark, sf_dir):
    base = X.read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS p", "date_format(o_orderdate, 'yyyy-MM-dd') AS d")
    return base.selectExpr("k", f"{_JSON} AS payload")


@query("""SELECT * FROM (VALUES ('id', 'integer', 1), ('price', 'float', 1), ('flag', 'integer', 1), ('mail', 'email', 1), ('placed', 'datetime', 1), ('tel', 'phone', 1),
    ('place', 'json', 1), ('mixed', 'string', 1), ('note', 'string', 1), ('extra', 'float', 3)) t(field, type, step)
    JOIN LATERAL (SELECT count(*) AS "values" FROM orders WHERE o_orderkey % step = 0) ON true""".replace("SELECT * FROM (VALUES", 'SELECT field, type, "values" FROM (VALUES', 1))
def infer_json_types(spark, sf_dir):
    return S.json_field_types(json_records(spark, sf_dir), "payload")


# ---- deep pages, versions with changed types, stored profiles ---------------------------------------
@query("""
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 300 DAY FROM orders) ORDER BY o_orderdate, o_orderkey DESC LIMIT 200""")
def query_page_after(spark, sf_dir):
    """The page behind a late day of all orders, by date and then by falling key: a filter and a top-k."""
    orders = X.read_table(spark, sf_dir, "orders")
    day = orders.agg(F.max("o_orderdate") - F.expr("INTERVAL 300 DAY")).first()[0]
    cursor = {"o_orderdate": day, "o_orderkey": None}  # nulls come last in falling order: all of that day is behind us
    return paging.seek(orders, ["o_orderdate", "-o_orderkey"], 200, cursor).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""
    SELECT 1 AS version, o_orderkey AS id, CAST(CAST(round(o_totalprice) AS BIGINT) AS DOUBLE) AS price, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS placed, CAST(o_custkey AS VARCHAR) AS customer, NULL AS note FROM orders
    UNION ALL SELECT 2, o_orderkey, CAST(o_totalprice AS DOUBLE), CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 3 HOUR, CAST(o_custkey AS VARCHAR), o_orderpriority FROM orders
    UNION ALL SELECT 3, o_orderkey, CAST(o_totalprice AS DOUBLE), NULL, 'c' || o_custkey, o_orderpriority FROM orders""")
def read_versions_widened(spark, sf_dir):
    """Three versions in which a price became fractional, a date a time and a number a name."""
    path, orders = work_path(spark, "widened"), X.read_table(spark, sf_dir, "orders")
    day, price, key = F.col("o_orderdate").cast("date"), F.col("o_totalprice"), F.col("o_orderkey").alias("id")
    orders.select(key, F.round(price).cast("bigint").alias("price"), day.alias("placed"), F.col("o_custkey").alias("customer")).write.parquet(f"{path}/version=1")
    orders.select(key, price.cast("double").alias("price"), (day.cast("timestamp_ntz") + F.expr("INTERVAL 3 HOUR")).alias("placed"), F.col("o_custkey").alias("customer"),
                  F.col("o_orderpriority").alias("note")).write.parquet(f"{path}/version=2")
    orders.select(key, price.cast("double").alias("price"), F.concat(F.lit("c"), F.col("o_custkey")).alias("customer"), F.col("o_orderpriority").alias("note")).write.parquet(f"{path}/version=3")
    return N.read_versions(spark, path, [1, 2, 3])


@query(with_blocks(["dprof"], "SELECT field, detected_type, total_values::BIGINT AS total_values, null_count::BIGINT AS null_count, nullable, CAST(min_length AS INTEGER) AS min_length, "
                   "CAST(max_length AS INTEGER) AS max_length, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUM) + ", true AS distinct_near FROM dprof"))
def profile_of_loads(spark, sf_dir):
    """Three loads, the second delivered twice: their stored states give the profile of the whole table."""
    tables = Tables(spark, work_path(spark, "profiles"), key=T.LOAD)
    df = X.cleaned(spark, sf_dir)
    for load in (0, 1, 2, 1):
        T.add_load(tables, df.filter(F.col("cust_key") % 3 == load), f"load-{load}", X.DIRTY_FIELDS)
    rows = rounded(T.stored_profile(tables), *_NUM)
    return near(spark, sf_dir, rows.select("field", "detected_type", "total_values", "null_count", "unique_values", "nullable", "min_length", "max_length", *_NUM))
