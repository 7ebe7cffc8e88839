"""Inputs derived from the given tables, as DataFrames and as the same SQL blocks.

Defects are arithmetic on keys, so both forms hold identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.detectors import quality_level
from ..operators.clean import clean
from ..session import read_table
from . import ctes
from .ctes import block



def now() -> Column:
    """The as-of time of the reports: a parameter, never the clock."""
    return F.lit(ctes.NOW).cast("timestamp_ntz")


# --------------------------------------------------------------------------------------------
# DIRTY: customers as text with defects
# --------------------------------------------------------------------------------------------
DIRTY_FIELDS = ["name", "segment", "email", "balance", "phone", "metro", "zip"]
DEFECT_STEPS = [11, 13, 17, 19, 23, 29, 37]


def _money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")

    def every(step: int) -> Column:
        return k % step == 0

    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@example.com"))
    return read_table(spark, sf_dir, "customer").select(
        k.alias("cust_key"),
        F.when(every(17), F.lit(None)).when(every(37), "X").otherwise(F.col("c_name")).alias("name"),
        F.when(every(19), "").when(every(13), F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")))
        .otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(every(11), F.replace(mail, F.lit("@"), F.lit("."))).otherwise(mail).alias("email"),
        F.when(every(23), "N/A").when(every(29), _money(F.col("c_acctbal") * 1000))
        .otherwise(_money(F.col("c_acctbal"))).alias("balance"),
        F.concat(F.lit("+1555"), F.lpad(k.cast("string"), 7, "0")).alias("phone"),
        F.element_at(F.array(*[F.lit(w) for w in ("TRUE", "no", "Y", "maybe")]), (k % 4 + 1).cast("int")).alias("metro"),
        F.lpad(k.cast("string"), 5, "0").alias("zip"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(dirty(spark, sf_dir), DIRTY_FIELDS)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows no defect touches; rules learned elsewhere would take the defects for normal."""
    sound = F.lit(True)
    for step in DEFECT_STEPS:
        sound = sound & (F.col("cust_key") % step != 0)
    return cleaned(spark, sf_dir).filter(sound)


block("dirty", """
    SELECT c_custkey AS cust_key,
           CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'X' ELSE c_name END AS name,
           CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN '  ' || lower(c_mktsegment) || ' ' ELSE c_mktsegment END AS segment,
           CASE WHEN c_custkey % 11 = 0 THEN replace(lower(replace(c_name, '#', '')) || '@example.com', '@', '.')
                ELSE lower(replace(c_name, '#', '')) || '@example.com' END AS email,
           CASE WHEN c_custkey % 23 = 0 THEN 'N/A' WHEN c_custkey % 29 = 0 THEN CAST(CAST(c_acctbal * 1000 AS DECIMAL(18,2)) AS VARCHAR)
                ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS balance,
           '+1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
           CASE c_custkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' ELSE 'maybe' END AS metro,
           lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip
    FROM customer""")


def _clean_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ({ctes.text_list(['', 'NULL', 'null', 'None', 'nan'])}) THEN NULL ELSE trim({c}) END"


block("cleaned", f"""
    SELECT * FROM (SELECT cust_key, {', '.join(_clean_sql(f) + ' AS ' + f for f in DIRTY_FIELDS)} FROM dirty)
    WHERE coalesce({', '.join(DIRTY_FIELDS)}) IS NOT NULL""", ["dirty"])
block("train", "SELECT * FROM cleaned WHERE " + " AND ".join(f"cust_key % {s} <> 0" for s in DEFECT_STEPS), ["cleaned"])
ctes.histogram_block("dhist", "cleaned", DIRTY_FIELDS)
ctes.profile_blocks("dprof", "dhist")
ctes.histogram_block("thist", "train", DIRTY_FIELDS)
ctes.profile_blocks("tprof", "thist")

# Rules of the training rows, the cells they judge and the record results.
block("tallowed", """
    SELECT h.field_id, h.field, h.value FROM thist h JOIN tprof p USING (field_id)
    WHERE p.is_categorical AND h.value IS NOT NULL""", ["thist", "tprof"])
block("trules", """
    SELECT field_id, field, detected_type AS kind, NOT nullable AS required,
           CASE WHEN min_length IS NOT NULL THEN greatest(1, min_length - 2) END AS min_length, max_length + 10 AS max_length,
           min_value - 2 * coalesce(std_value, 0) AS min_value, max_value + 2 * coalesce(std_value, 0) AS max_value,
           is_categorical AS categorical
    FROM tprof""", ["tprof"])
_kinds = " ".join(f"WHEN '{t}' THEN {ctes.sql_matches(t, 'value')}" for t in ctes.DETECTED)
block("cells", " UNION ALL ".join(
    f"SELECT cust_key, {i} AS field_id, '{f}' AS field, {f} AS value FROM cleaned" for i, f in enumerate(DIRTY_FIELDS)), ["cleaned"])
block("checks", f"""
    SELECT cust_key, field_id, field, value, kind, required, value IS NULL OR value = '' AS blank,
           NOT coalesce(CASE kind {_kinds} ELSE true END, true) AS type_bad,
           coalesce(length(value) < min_length, false) AS short_bad, coalesce(length(value) > max_length, false) AS long_bad,
           coalesce(kind IN ('integer', 'float') AND x < min_value, false) AS below_bad,
           coalesce(kind IN ('integer', 'float') AND x > max_value, false) AS above_bad,
           coalesce(categorical AND value IS NOT NULL AND allowed_value IS NULL AND field_id IN (SELECT field_id FROM tallowed), false) AS category_bad,
           kind IN ({ctes.text_list(list(V.PATTERNS))}) AS patterned,
           min_length, max_length, min_value, max_value
    FROM (SELECT c.*, r.* EXCLUDE (field_id, field), a.value AS allowed_value, {ctes.sql_number('c.value')} AS x
          FROM cells c JOIN trules r USING (field_id) LEFT JOIN tallowed a ON a.field_id = c.field_id AND a.value = c.value)""",
      ["cells", "trules", "tallowed"])
block("scored", """
    SELECT *, CASE WHEN blank AND required THEN 0.0 WHEN blank THEN 0.9 ELSE
        CAST(1.0 AS DOUBLE) * CAST(CASE WHEN type_bad THEN 0.5 ELSE 1.0 END AS DOUBLE)
        * CAST(CASE WHEN short_bad THEN 0.7 WHEN long_bad THEN 0.8 ELSE 1.0 END AS DOUBLE)
        * CAST(CASE WHEN below_bad OR above_bad THEN 0.7 ELSE 1.0 END AS DOUBLE)
        * CAST(CASE WHEN category_bad THEN 0.9 ELSE 1.0 END AS DOUBLE)
        * CAST(CASE WHEN patterned AND type_bad THEN 0.6 ELSE 1.0 END AS DOUBLE) END AS field_score
    FROM checks""", ["checks"])
block("issues", """
    SELECT cust_key, field_id, field, 'missing_value' AS issue_type, 'Field cannot be null' AS description FROM checks WHERE blank AND required
    UNION ALL SELECT cust_key, field_id, field, 'invalid_format', 'Invalid ' || kind || ' format' FROM checks WHERE NOT blank AND type_bad
    UNION ALL SELECT cust_key, field_id, field, 'length_violation', 'Value too short (min: ' || min_length || ')' FROM checks WHERE NOT blank AND short_bad
    UNION ALL SELECT cust_key, field_id, field, 'length_violation', 'Value too long (max: ' || max_length || ')' FROM checks WHERE NOT blank AND long_bad
    UNION ALL SELECT cust_key, field_id, field, 'out_of_range', 'Value below minimum' FROM checks WHERE NOT blank AND below_bad
    UNION ALL SELECT cust_key, field_id, field, 'out_of_range', 'Value above maximum' FROM checks WHERE NOT blank AND above_bad
    UNION ALL SELECT cust_key, field_id, field, 'inconsistent_pattern', 'Value doesn''t match expected pattern' FROM checks WHERE NOT blank AND patterned AND type_bad
    """, ["checks"])
block("warns", """
    SELECT cust_key, field_id, field, 'Field ''' || field || ''' has unexpected category: ' || value AS warning
    FROM checks WHERE NOT blank AND category_bad""", ["checks"])
_sum = " + ".join(f"max(CASE WHEN field_id = {i} THEN field_score END)" for i in range(len(DIRTY_FIELDS)))
block("res", f"""
    SELECT cust_key, issue_count = 0 AND quality_score >= 0.6 AS is_valid, quality_score, {ctes.sql_level('quality_score')} AS quality_level,
           issue_count, warning_count
    FROM (SELECT s.cust_key, CAST(({_sum}) AS DOUBLE) / {len(DIRTY_FIELDS)} AS quality_score,
                 coalesce(max(i.n), 0) AS issue_count, coalesce(max(w.n), 0) AS warning_count
          FROM scored s LEFT JOIN (SELECT cust_key, count(*) AS n FROM issues GROUP BY cust_key) i USING (cust_key)
          LEFT JOIN (SELECT cust_key, count(*) AS n FROM warns GROUP BY cust_key) w USING (cust_key)
          GROUP BY s.cust_key)""", ["scored", "issues", "warns"])


# --------------------------------------------------------------------------------------------
# ORD: order lines as delivered records
# --------------------------------------------------------------------------------------------
def ord_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    k = F.col("o_custkey")
    number = F.lpad(k.cast("string"), 5, "0")
    return joined.select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_linenumber").alias("LineNumber"),
        F.when(k % 41 == 0, F.concat(F.lit("cu"), number)).otherwise(number).alias("CustomerID"),
        F.to_date("o_orderdate").cast("string").alias("OrderDate"),
        F.to_date("l_shipdate").cast("string").alias("ShippedDate"),
        F.when(F.col("l_partkey") % 31 == 0, F.lit(None))
        .when(F.col("l_partkey") % 29 == 0, -F.col("l_extendedprice") / 100)
        .otherwise(F.col("l_extendedprice") / 100).alias("Freight"),
        F.col("l_partkey").alias("PartID"),
        F.col("l_suppkey").alias("SupplierID"),
    )


block("ord", """
    SELECT l_orderkey AS "OrderID", l_linenumber AS "LineNumber",
           CASE WHEN o_custkey % 41 = 0 THEN 'cu' ELSE '' END || lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS "CustomerID",
           strftime(o_orderdate, '%Y-%m-%d') AS "OrderDate", strftime(l_shipdate, '%Y-%m-%d') AS "ShippedDate",
           CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 29 = 0 THEN -l_extendedprice / 100 ELSE l_extendedprice / 100 END AS "Freight",
           l_partkey AS "PartID", l_suppkey AS "SupplierID"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


# --------------------------------------------------------------------------------------------
# JOBS: one processing job per order, with its source, record results and metrics
# --------------------------------------------------------------------------------------------
def _jobs_from(orders: DataFrame, lines: DataFrame) -> DataFrame:
    # lines are combined per order before the join, so a hot order travels as one row per task
    rejected = F.col("l_returnflag") == "R"
    totals = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("total"),
        F.sum(F.when(rejected, F.col("l_quantity").cast("long")).otherwise(0)).alias("invalid"),
        F.sum(F.when(rejected & (F.col("l_linestatus") == "F"), F.col("l_quantity").cast("long")).otherwise(0)).alias("quarantined"),
        (1 - F.avg("l_discount") * 2).alias("avg_quality_score"),
    )
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    )
    prefix = (
        F.when(F.col("o_orderpriority").startswith("1"), "orders_feed_")
        .when(F.col("o_orderpriority").startswith("2"), "beneficiary_file_")
        .when(F.col("o_orderpriority").startswith("3"), "training_set_")
        .otherwise("upload_")
    )
    jobs = orders.select(
        k.alias("job_id"),
        F.concat(prefix, k.cast("string")).alias("job_name"),
        F.element_at(F.array(F.lit("file"), F.lit("api"), F.lit("stream")), (k % 3 + 1).cast("int")).alias("job_type"),
        status.alias("status"),
        F.col("o_custkey").alias("source_id"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("created_at"),
        (F.col("o_totalprice") / 1000).alias("processing_duration_seconds"),
        F.when(status == "failed", "Source unreachable").alias("error_message"),
    ).withColumn("started_at", F.col("created_at") + F.make_dt_interval(mins=(F.col("job_id") % 50).cast("int"))).withColumn(
        "completed_at",
        F.when(F.col("status").isin("completed", "failed"),
               F.col("started_at") + F.make_dt_interval(secs=F.floor("processing_duration_seconds").cast("decimal(18,6)"))))
    counted = jobs.join(totals, "job_id", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return counted.select(
        *jobs.columns,
        zero("total").alias("total_records"),
        (zero("total") - zero("invalid")).alias("valid_records"),
        zero("invalid").alias("invalid_records"),
        zero("quarantined").alias("quarantined_records"),
        "avg_quality_score",
        F.when(zero("total") > 0, (zero("total") - zero("invalid")) / zero("total")).otherwise(0.0).alias("success_rate"),
        F.date_format("started_at", "yyyyMMdd").cast("int").alias("start_date_id"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs_from(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sources: customers outside the nations whose key ends in 9, so that joins lose rows."""
    k = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").filter(F.col("c_nationkey") % 10 != 9).select(
        k.alias("source_id"), F.col("c_name").alias("source_name"), F.lower("c_mktsegment").alias("source_type"),
        F.element_at(F.array(F.lit("csv"), F.lit("json"), F.lit("parquet")), (k % 3 + 1).cast("int")).alias("source_format"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record results of the jobs: one per order line, with issues as ``type: detail`` text."""
    score = F.round(1 - F.col("l_discount") * 4, 4)
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("record_id"),
        F.col("l_partkey").alias("part_key"),
        (F.col("l_returnflag") != "R").alias("is_valid"),
        score.alias("quality_score"), quality_level(score).alias("quality_level"),
        F.array_compact(F.array(
            F.when(F.col("l_partkey") % 29 == 0, F.lit("missing_value: Freight is empty")),
            F.when(F.col("l_returnflag") == "R", F.lit("invalid_format: Returned line")),
            F.when(F.col("l_tax") > 0.06, F.lit("out_of_range: Tax above limit")),
            F.when(F.col("l_suppkey") % 17 == 0, F.lit("null_supplier")),
        )).alias("issues"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("validated_at"),
    )


block("jobs", """
    SELECT *, created_at + to_minutes(CAST(job_id % 50 AS INTEGER)) AS started_at,
           CASE WHEN status IN ('completed', 'failed')
                THEN created_at + to_minutes(CAST(job_id % 50 AS INTEGER)) + to_seconds(CAST(floor(processing_duration_seconds) AS INTEGER)) END AS completed_at,
           CAST(strftime(created_at + to_minutes(CAST(job_id % 50 AS INTEGER)), '%Y%m%d') AS INTEGER) AS start_date_id,
           CASE WHEN total_records > 0 THEN valid_records / total_records ELSE 0.0 END AS success_rate
    FROM (SELECT o_orderkey AS job_id,
                 CASE left(o_orderpriority, 1) WHEN '1' THEN 'orders_feed_' WHEN '2' THEN 'beneficiary_file_' WHEN '3' THEN 'training_set_' ELSE 'upload_' END || o_orderkey AS job_name,
                 CASE o_orderkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'api' ELSE 'stream' END AS job_type,
                 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
                 o_custkey AS source_id, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at,
                 o_totalprice / 1000 AS processing_duration_seconds,
                 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'Source unreachable' END AS error_message,
                 CAST(coalesce(total, 0) AS BIGINT) AS total_records, CAST(coalesce(total, 0) - coalesce(invalid, 0) AS BIGINT) AS valid_records,
                 CAST(coalesce(invalid, 0) AS BIGINT) AS invalid_records, CAST(coalesce(quarantined, 0) AS BIGINT) AS quarantined_records, avg_quality_score
          FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS total,
                    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS invalid,
                    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS quarantined,
                    1 - avg(l_discount) * 2 AS avg_quality_score FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)""")
block("sources", """
    SELECT c_custkey AS source_id, c_name AS source_name, lower(c_mktsegment) AS source_type,
           CASE c_custkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'parquet' END AS source_format
    FROM customer WHERE c_nationkey % 10 <> 9""")
block("results", f"""
    SELECT *, {ctes.sql_level('quality_score')} AS quality_level FROM (
    SELECT l_orderkey AS job_id, l_linenumber AS record_id, l_partkey AS part_key, l_returnflag <> 'R' AS is_valid,
           round(1 - l_discount * 4, 4) AS quality_score,
           list_filter([CASE WHEN l_partkey % 29 = 0 THEN 'missing_value: Freight is empty' END,
                        CASE WHEN l_returnflag = 'R' THEN 'invalid_format: Returned line' END,
                        CASE WHEN l_tax > 0.06 THEN 'out_of_range: Tax above limit' END,
                        CASE WHEN l_suppkey % 17 = 0 THEN 'null_supplier' END], lambda x: x IS NOT NULL) AS issues,
           CAST(l_shipdate AS TIMESTAMP) AS validated_at
    FROM lineitem)""")


# --------------------------------------------------------------------------------------------
# SAMPLES: one column of text per semantic type, sound and broken values mixed
# --------------------------------------------------------------------------------------------
# type -> SQL text over k (order key), d (order date) and p (total price); valid in both dialects
_K = "CAST(k AS STRING)"
SAMPLE_SQL = {
    "email": f"CASE WHEN k % 7 = 0 THEN concat('user', {_K}, '@mail') ELSE concat('User.', {_K}, '@mail', CAST(k % 7 AS STRING), '.example.com') END",
    "phone": f"CASE k % 4 WHEN 0 THEN concat('(555) 123-', lpad(CAST(k % 10000 AS STRING), 4, '0')) WHEN 1 THEN concat('+1555', lpad({_K}, 7, '0')) WHEN 2 THEN concat('555.010.', lpad(CAST(k % 10000 AS STRING), 4, '0')) ELSE CASE WHEN k % 5 = 0 THEN 'ext 12' ELSE '555-010-1234' END END",
    "url": f"CASE WHEN k % 6 = 0 THEN concat('ftp://files.example.com/', {_K}) ELSE concat('https://shop.example.com/item/', {_K}, '?ref=', CAST(k % 9 AS STRING)) END",
    "uuid": "CASE WHEN k % 8 = 0 THEN concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-7', substr(h, 14, 3), '-a', substr(h, 18, 3), '-', substr(h, 21, 12)) ELSE concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-a', substr(h, 18, 3), '-', substr(h, 21, 12)) END",
    "currency": f"CASE WHEN k % 9 = 0 THEN concat('USD ', {_K}) WHEN k % 4 = 0 THEN concat(CAST(CAST(p AS DECIMAL(18,2)) AS STRING), ' USD') ELSE concat('$', CAST(CAST(p AS DECIMAL(18,2)) AS STRING)) END",
    "percentage": "CASE WHEN k % 7 = 0 THEN CAST(k % 100 AS STRING) ELSE concat(CAST(k % 100 AS STRING), '.', CAST(k % 10 AS STRING), '%') END",
    "postal_code": "CASE WHEN k % 11 = 0 THEN 'AB12' WHEN k % 3 = 0 THEN concat('K1A 0B', CAST(k % 10 AS STRING)) WHEN k % 3 = 1 THEN lpad(CAST(k % 100000 AS STRING), 5, '0') ELSE concat(lpad(CAST(k % 100000 AS STRING), 5, '0'), '-', lpad(CAST(k % 10000 AS STRING), 4, '0')) END",
    "ip_address": "concat(CAST(k % 224 AS STRING), '.', CAST(k % 200 AS STRING), '.', CAST(k % 300 AS STRING), '.1')",
    "credit_card": "CASE WHEN k % 7 = 0 THEN '4111-1111-1111-111' WHEN k % 2 = 0 THEN concat('4111 1111 1111 ', lpad(CAST(k % 10000 AS STRING), 4, '0')) ELSE concat('4111-1111-1111-', lpad(CAST(k % 10000 AS STRING), 4, '0')) END",
    "social_security": "CASE WHEN k % 9 = 0 THEN 'SSN?' WHEN k % 5 = 0 THEN lpad(CAST(k % 1000000 AS STRING), 9, '1') ELSE concat(lpad(CAST(k % 1000 AS STRING), 3, '0'), '-', lpad(CAST(k % 100 AS STRING), 2, '0'), '-', lpad(CAST(k % 10000 AS STRING), 4, '0')) END",
    "integer": f"CASE k % 12 WHEN 0 THEN concat('1_', lpad(CAST(k % 1000 AS STRING), 3, '0')) WHEN 1 THEN concat(' ', {_K}, ' ') WHEN 2 THEN '32.38' ELSE concat('-', {_K}) END",
    "float": f"CASE k % 12 WHEN 0 THEN '1e5' WHEN 1 THEN '.5' WHEN 2 THEN '1.5e3' WHEN 3 THEN 'abc' ELSE concat('-', {_K}, '.25') END",
    "boolean": "CASE k % 11 WHEN 0 THEN 'true' WHEN 1 THEN 'NO' WHEN 2 THEN '1' WHEN 3 THEN 'y' WHEN 4 THEN 'maybe' WHEN 5 THEN 'False' ELSE 'n' END",
    "date": "CASE k % 10 WHEN 0 THEN concat(y, '-', m, '-', dd) WHEN 1 THEN concat(m, '/', dd, '/', y) WHEN 2 THEN concat(dd, '/', m, '/', y) WHEN 3 THEN concat(y, '/', m, '/', dd) WHEN 4 THEN concat(dd, '-', m, '-', y) WHEN 5 THEN concat(m, '-', dd, '-', y) WHEN 6 THEN concat('March ', dd, ', ', y) WHEN 7 THEN concat(dd, ' december ', y) WHEN 8 THEN concat(y, '-2-30') ELSE concat(y, '-', m, '-', dd) END",
    "datetime": "CASE k % 8 WHEN 0 THEN concat(y, '-', m, '-', dd, ' 10:05:06') WHEN 1 THEN concat(y, '-', m, '-', dd, ' 1:05:06.125') WHEN 2 THEN concat(y, '-', m, '-', dd, 'T10:05:06') WHEN 3 THEN concat(y, '-', m, '-', dd, 'T10:05:06.123456') WHEN 4 THEN concat(y, '-', m, '-', dd, 'T10:05:06Z') WHEN 5 THEN concat(m, '/', dd, '/', y, ' 10:05:06') WHEN 6 THEN concat(y, '-', m, '-', dd, ' 10:05') ELSE concat(y, '-', m, '-', dd, ' 23:59:59') END",
    "json": "CASE k % 8 WHEN 0 THEN '[1, 2]' WHEN 1 THEN 'true' WHEN 2 THEN '7' WHEN 3 THEN '{bad' WHEN 4 THEN 'nan' WHEN 5 THEN '\"text\"' ELSE concat('{\"k\": ', CAST(k AS STRING), '}') END",
    "category": "CASE WHEN k % 3 = 0 THEN 'gold tier' WHEN k % 3 = 1 THEN 'silver tier' ELSE 'bronze tier' END",
}
SAMPLE_FIELDS = [f"s_{name}" for name in SAMPLE_SQL]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_totalprice AS p", "md5(CAST(o_orderkey AS STRING)) AS h",
        "CAST(year(o_orderdate) AS STRING) AS y", "CAST(month(o_orderdate) AS STRING) AS m", "CAST(day(o_orderdate) AS STRING) AS dd")
    return base.selectExpr("k", *[f"{sql} AS s_{name}" for name, sql in SAMPLE_SQL.items()])


block("samples", "SELECT k, " + ", ".join(f"{sql} AS s_{name}" for name, sql in SAMPLE_SQL.items()) + """
    FROM (SELECT o_orderkey AS k, o_totalprice AS p, md5(CAST(o_orderkey AS VARCHAR)) AS h, CAST(year(o_orderdate) AS VARCHAR) AS y,
          CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(day(o_orderdate) AS VARCHAR) AS dd FROM orders)""")
ctes.histogram_block("shist", "samples", SAMPLE_FIELDS)
ctes.profile_blocks("sprof", "shist")
