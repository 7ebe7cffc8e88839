"""Queries: cleaning projections, normalisers, type detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import normalise as N
from ..functions.detectors import DETECTORS, fits_loosely
from ..operators import clean as C
from ..operators import profile as P
from ..operators.registry import storage_type
from . import fixtures as X
from .catalog import query, register
from .ctes import DETECTED, sql_matches, text_list, with_blocks


# ---- detection of each type over every sample column ----------------------------------------
def _detect(kind: str):
    def run(spark, sf_dir):
        rows = P.count_cells(X.samples(spark, sf_dir), X.SAMPLE_FIELDS, matches=DETECTORS[kind](F.col("value")))
        return rows.select(F.col("field").alias("column_name"), "matches", "total")

    sql = with_blocks(["samples"], " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {sql_matches(kind, c)}) AS matches, count(*) AS total FROM samples"
        for c in X.SAMPLE_FIELDS))
    register(f"detect_{kind}", run, sql)


for _kind in DETECTED:
    _detect(_kind)


@query(with_blocks(["shist"], f"""
    SELECT field, sum(n) FILTER (WHERE value IS NOT NULL)::BIGINT AS filled, count(value) AS unique_values,
           count(value) / sum(n) FILTER (WHERE value IS NOT NULL) < {V.CATEGORY_RATIO} AND count(value) < {V.CATEGORY_DISTINCT} AS categorical
    FROM shist GROUP BY field"""))
def detect_categorical(spark, sf_dir):
    rows = P.profile_basic(X.samples(spark, sf_dir), X.SAMPLE_FIELDS)
    filled, distinct = F.col("total_values") - F.col("null_count"), F.col("unique_values")
    return rows.select("field", filled.alias("filled"), distinct.alias("unique_values"), (
        (distinct / filled < V.CATEGORY_RATIO) & (distinct < V.CATEGORY_DISTINCT)).alias("categorical"))


@query(with_blocks(["sprof", "dprof"], "SELECT field, detected_type FROM sprof UNION ALL SELECT field, detected_type FROM dprof"))
def detect_types(spark, sf_dir):
    a = P.profile(X.samples(spark, sf_dir), X.SAMPLE_FIELDS)
    b = P.profile(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)
    return a.select("field", "detected_type").unionByName(b.select("field", "detected_type"))


# ---- cleaning --------------------------------------------------------------------------------
def _messy(spark, sf_dir):
    """DIRTY under the column names of a spreadsheet."""
    return X.dirty(spark, sf_dir).withColumnsRenamed({"name": " Company Name ", "zip": "Postal Code"})


_REST = "segment, email, balance, phone, metro"


@query(with_blocks(["dirty"], f'SELECT cust_key, name AS "Company_Name", {_REST}, zip AS "Postal_Code" FROM dirty'))
def clean_column_names(spark, sf_dir):
    return C.standardise_names(_messy(spark, sf_dir))


def _sql_tokens(c: str, tokens: list[str]) -> str:
    return f"CASE WHEN trim({c}) IN ({text_list(tokens)}) THEN NULL ELSE {c} END AS {c}"


@query(with_blocks(["dirty"], "SELECT cust_key, " + ", ".join(_sql_tokens(f, V.CLEAN_NULL_TOKENS) for f in X.DIRTY_FIELDS) + " FROM dirty"))
def clean_null_tokens(spark, sf_dir):
    return C.null_tokens(X.dirty(spark, sf_dir))


@query(with_blocks(["dirty"], "SELECT cust_key, " + ", ".join(
    f"CASE WHEN trim({f}) IN ({text_list(V.RESIDUE_TOKENS)}) THEN NULL ELSE trim({f}) END AS {f}" for f in X.DIRTY_FIELDS) + " FROM dirty"))
def clean_trim(spark, sf_dir):
    return C.trim_text(X.dirty(spark, sf_dir))


def _sparse(spark, sf_dir):
    """Order lines whose optional columns are null for most keys."""
    k = F.col("PartID")
    return X.ord_records(spark, sf_dir).select(
        F.when(k % 3 == 0, F.col("Freight")).alias("freight"), F.when(k % 5 == 0, F.col("ShippedDate")).alias("shipped"),
        F.when(k % 7 == 0, F.col("SupplierID")).alias("supplier"))


@query(with_blocks(["ord"], """
    SELECT * FROM (SELECT CASE WHEN "PartID" % 3 = 0 THEN "Freight" END AS freight, CASE WHEN "PartID" % 5 = 0 THEN "ShippedDate" END AS shipped,
                          CASE WHEN "PartID" % 7 = 0 THEN "SupplierID" END AS supplier FROM ord)
    WHERE NOT (freight IS NULL AND shipped IS NULL AND supplier IS NULL)"""))
def drop_all_null_rows(spark, sf_dir):
    return C.drop_empty_rows(_sparse(spark, sf_dir))


@query(with_blocks(["cleaned"], 'SELECT cust_key, name AS "Company_Name", segment, email, balance, phone, metro, zip AS "Postal_Code" FROM cleaned'))
def clean_full(spark, sf_dir):
    payload = [c for c in _messy(spark, sf_dir).columns if c != "cust_key"]
    return C.clean(_messy(spark, sf_dir), payload)


def nested_orders(spark, sf_dir):
    """Orders with nested price and date objects."""
    return X.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"),
        F.struct(F.col("o_totalprice").alias("total"), F.struct(F.lit("USD").alias("code")).alias("currency")).alias("price"),
        F.struct(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).alias("placed"))


@query("""SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS "price.total", 'USD' AS "price.currency.code",
          CAST(year(o_orderdate) AS INTEGER) AS "placed.year", CAST(month(o_orderdate) AS INTEGER) AS "placed.month" FROM orders""")
def flatten_nested(spark, sf_dir):
    return C.flatten(nested_orders(spark, sf_dir))


# ---- static customer record -------------------------------------------------------------------
# The ten fields of the static record over customer, padded and partly empty.
STATIC_SQL = {
    "customer_id": "CASE WHEN k % 43 = 0 THEN '  ' ELSE concat(' c', k, ' ') END",
    "company_name": "CASE WHEN k % 17 = 0 THEN ' ' ELSE concat('  ', n) END",
    "contact_name": "concat('Contact ', k)",
    "contact_title": "CASE WHEN k % 5 = 0 THEN '' ELSE 'Owner' END",
    "city": "CASE WHEN k % 31 = 0 THEN NULL ELSE concat('City ', nk) END",
    "region": "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 53 = 0 THEN repeat('r', 60) ELSE 'West' END",
    "postal_code": "CASE WHEN k % 6 = 0 THEN ' 12' WHEN k % 7 = 0 THEN '1234' ELSE lpad(CAST(k AS STRING), 5, '0') END",
    "country": "CASE WHEN k % 61 = 0 THEN 'X' ELSE 'Norway' END",
    "segment": "CASE k % 8 WHEN 0 THEN 'healthcare' WHEN 1 THEN ' RETAIL ' WHEN 2 THEN 'finance' WHEN 3 THEN 'public sector' WHEN 4 THEN 'Education' ELSE s END",
    "metro_area": "CASE k % 6 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE 'Yes' END",
}
X.block("static", "SELECT k AS cust_key, " + ", ".join(f"{sql} AS {f}" for f, sql in STATIC_SQL.items()) +
        " FROM (SELECT c_custkey AS k, c_name AS n, c_nationkey AS nk, c_mktsegment AS s FROM customer)")


def static_records(spark, sf_dir):
    base = X.read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS n", "c_nationkey AS nk", "c_mktsegment AS s")
    return base.selectExpr("k AS cust_key", *[f"{sql} AS {f}" for f, sql in STATIC_SQL.items()])


@query(with_blocks(["static"], "SELECT cust_key, CASE WHEN length(upper(trim(customer_id))) > 0 THEN upper(trim(customer_id)) END AS customer_id FROM static"))
def norm_id(spark, sf_dir):
    return static_records(spark, sf_dir).select("cust_key", N.identifier(F.col("customer_id")).alias("customer_id"))


@query(with_blocks(["static"], "SELECT cust_key, CASE WHEN length(trim(company_name)) > 0 THEN trim(company_name) END AS company_name FROM static"))
def norm_name(spark, sf_dir):
    return static_records(spark, sf_dir).select("cust_key", N.person_name(F.col("company_name")).alias("company_name"))


@query(with_blocks(["static"], "SELECT cust_key, CASE WHEN length(trim(postal_code)) >= 3 THEN trim(postal_code) END AS postal_code FROM static"))
def norm_postal(spark, sf_dir):
    return static_records(spark, sf_dir).select("cust_key", N.postal(F.col("postal_code")).alias("postal_code"))


@query(with_blocks(["static"], f"""
    SELECT cust_key, CASE WHEN lower(trim(metro_area)) IN ({text_list(V.TRUE_WORDS)}) THEN 'true'
                          WHEN lower(trim(metro_area)) IN ({text_list(V.FALSE_WORDS)}) THEN 'false' ELSE metro_area END AS metro_area FROM static"""))
def norm_boolean(spark, sf_dir):
    return static_records(spark, sf_dir).select("cust_key", N.boolean_like(F.col("metro_area")).alias("metro_area"))


_TITLE = "list_aggregate(list_transform(string_split(lower(trim(segment)), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"


@query(with_blocks(["static"], f"SELECT cust_key, {_TITLE} AS segment, {_TITLE} IN ({text_list(V.SEGMENTS)}) AS known FROM static"))
def norm_segment(spark, sf_dir):
    return static_records(spark, sf_dir).select(
        "cust_key", N.segment(F.col("segment")).alias("segment"), N.segment_known(F.col("segment")).alias("known"))


@query(with_blocks(["static"], "SELECT * FROM static"))
def rename_aliases(spark, sf_dir):
    return C.rename(static_records(spark, sf_dir).withColumnsRenamed(V.CUSTOMER_ALIASES))


@query("""SELECT 'job-' || o_custkey AS job_id, 'orders' AS source_file, o_orderkey AS row_index,
                 CASE WHEN o_orderstatus = 'P' THEN 'invalid' ELSE 'valid' END AS validation_status, o_totalprice / 1000000 AS quality_score,
                 TIMESTAMP '2001-08-02 00:00:00' AS ingestion_time,
                 '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload FROM orders""")
def envelope_project(spark, sf_dir):
    orders = X.read_table(spark, sf_dir, "orders")
    return C.envelope(
        orders, job_id=F.concat(F.lit("job-"), F.col("o_custkey").cast("string")), source_file=F.lit("orders"),
        row_index=F.col("o_orderkey"), status=F.when(F.col("o_orderstatus") == "P", "invalid").otherwise("valid"),
        score=F.col("o_totalprice") / 1000000, ingestion_time=X.now(), payload=["o_orderkey", "o_orderstatus"])


# ---- loose checks -------------------------------------------------------------------------------
_LOOSE = ["integer", "float", "boolean", "datetime", "email", "phone", "url"]


def _loose_sql(kind: str, c: str) -> str:
    return {
        "integer": f"regexp_matches({c}, '^\\d+$')",
        "float": f"regexp_matches({c}, '(?i){V.NUMBER_PATTERN}')",
        "boolean": f"lower({c}) IN ({text_list(V.LOOSE_BOOLEAN_WORDS)})",
        "datetime": f"({sql_matches('date', c)} OR {sql_matches('datetime', c)})",
        "email": f"(contains({c}, '@') AND contains({c}, '.'))",
        "phone": f"length(replace(replace({c}, ' ', ''), '-', '')) >= 10",
        "url": f"(starts_with({c}, 'http://') OR starts_with({c}, 'https://'))",
    }[kind]


@query(with_blocks(["samples"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, " + ", ".join(f"count(*) FILTER (WHERE {_loose_sql(k, c)}) AS as_{k}" for k in _LOOSE) + " FROM samples"
    for c in X.SAMPLE_FIELDS)))
def loose_type_check(spark, sf_dir):
    rows = P.count_cells(X.samples(spark, sf_dir), X.SAMPLE_FIELDS,
                         **{f"as_{k}": fits_loosely(F.col("value"), k) for k in _LOOSE})
    return rows.drop("total").withColumnRenamed("field", "column_name")


@query(with_blocks(["shist", "sprof", "dprof"], """
    SELECT field, CASE detected_type WHEN 'integer' THEN 'bigint' WHEN 'float' THEN 'double' WHEN 'boolean' THEN 'boolean'
                  WHEN 'datetime' THEN 'timestamp' WHEN 'date' THEN 'date' ELSE 'string' END AS storage_type
    FROM (SELECT * FROM sprof UNION ALL SELECT * FROM dprof)"""))
def map_storage_type(spark, sf_dir):
    return detect_types(spark, sf_dir).select("field", storage_type(F.col("detected_type")).alias("storage_type"))

