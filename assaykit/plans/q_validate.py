"""Queries: record validation, checks, splits, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.detectors import as_text, number
from ..operators import checks as K
from ..operators import insights as I
from ..operators import profile as P
from ..operators import rules as R
from ..operators import validate as E
from ..session import work_path
from . import fixtures as X
from .catalog import query
from .ctes import NOW, block, sql_matches, sql_number, text_list, with_blocks
from .q_detect import static_records
from .q_profile import rounded


def learned(spark, sf_dir):
    return R.learn_rules(X.train(spark, sf_dir), X.DIRTY_FIELDS)


def res(spark, sf_dir, **options):
    """RES: every record judged by the rules of the sound ones."""
    return E.validate(X.cleaned(spark, sf_dir), learned(spark, sf_dir), ["cust_key"], **options)


def _field_scores(spark, sf_dir, fields):
    r = res(spark, sf_dir)
    return r.select("cust_key", F.explode("field_scores").alias("field", "field_score")).filter(
        F.col("field").isin(fields)).select("cust_key", "field", F.round("field_score", 6).alias("field_score"))


def _issue_count(spark, sf_dir, kinds):
    rows = E.issue_rows(res(spark, sf_dir), ["cust_key"])
    return rows.filter(F.col("issue_type").isin(kinds)).select("cust_key", "field", "issue_type")


def _issues_sql(*kinds):
    return with_blocks(["issues"], f"SELECT cust_key, field, issue_type FROM issues WHERE issue_type IN ({text_list(list(kinds))})")


# ---- absent and unexpected fields ---------------------------------------------------------------
@query(with_blocks(["cleaned", "trules"], """
    SELECT cust_key, count(*) FILTER (WHERE field IN ('phone', 'zip') AND required) AS absent_required,
           count(*) FILTER (WHERE field IN ('phone', 'zip') AND NOT required) AS absent_optional
    FROM cleaned CROSS JOIN trules GROUP BY cust_key"""))
def validate_absent_field(spark, sf_dir):
    r = E.validate(X.cleaned(spark, sf_dir).drop("phone", "zip"), learned(spark, sf_dir), ["cust_key"])
    return r.select(
        "cust_key",
        F.size(F.filter("issues", lambda i: i["description"] == "Required field is missing")).cast("long").alias("absent_required"),
        F.size(F.filter("warnings", lambda w: w.startswith("Optional field"))).cast("long").alias("absent_optional"))


@query(with_blocks(["cleaned"], "SELECT cust_key, 'Unexpected field ''surprise'' found' AS warning FROM cleaned"))
def validate_unexpected(spark, sf_dir):
    df = X.cleaned(spark, sf_dir).withColumn("surprise", F.col("zip"))
    r = E.validate(df, learned(spark, sf_dir), ["cust_key"])
    return r.select("cust_key", F.explode("warnings").alias("warning")).filter(F.col("warning").startswith("Unexpected"))


# ---- each check ------------------------------------------------------------------------------------
@query(_issues_sql("missing_value"))
def validate_nulls(spark, sf_dir):
    return _issue_count(spark, sf_dir, ["missing_value"])


@query(_issues_sql("invalid_format"))
def validate_type(spark, sf_dir):
    return _issue_count(spark, sf_dir, ["invalid_format"])


@query(_issues_sql("length_violation"))
def validate_length(spark, sf_dir):
    return _issue_count(spark, sf_dir, ["length_violation"])


@query(_issues_sql("out_of_range"))
def validate_range(spark, sf_dir):
    return _issue_count(spark, sf_dir, ["out_of_range"])


@query(_issues_sql("inconsistent_pattern"))
def validate_pattern(spark, sf_dir):
    return _issue_count(spark, sf_dir, ["inconsistent_pattern"])


@query(with_blocks(["warns"], "SELECT cust_key, warning FROM warns"))
def validate_category(spark, sf_dir):
    return res(spark, sf_dir).select("cust_key", F.explode("warnings").alias("warning"))


@query("""
    SELECT l_orderkey, l_linenumber, value AS part, CAST(0.9 AS DOUBLE) AS quality_score, 'Field ''part'' has unexpected category: ' || value AS warning
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN 'part x' ELSE 'part ' END || l_partkey || '.' AS value FROM lineitem)
    WHERE value NOT IN (SELECT DISTINCT 'part ' || l_partkey || '.' FROM lineitem)""")
def validate_category_table(spark, sf_dir):
    """Every line's part against all parts ever ordered: a table, as soon as they are more than a list holds."""
    lines = X.read_table(spark, sf_dir, "lineitem")
    name, strange = F.concat(F.col("l_partkey").cast("string"), F.lit(".")), F.col("l_orderkey") % 97 == 0
    rules = R.learn_rules(lines.select(F.concat(F.lit("part "), name).alias("part")))
    seen = lines.select("l_orderkey", "l_linenumber", F.concat(F.when(strange, "part x").otherwise("part "), name).alias("part"))
    results = E.validate(seen, rules, ["l_orderkey", "l_linenumber"])
    return results.select("l_orderkey", "l_linenumber", "part", "quality_score", F.explode("warnings").alias("warning"))


@query(with_blocks(["scored"], "SELECT cust_key, field, round(field_score, 6) AS field_score FROM scored"))
def field_scores(spark, sf_dir):
    return _field_scores(spark, sf_dir, X.DIRTY_FIELDS)


@query(with_blocks(["res"], "SELECT cust_key, is_valid, round(quality_score, 6) AS quality_score, issue_count, warning_count FROM res"))
def validate_record(spark, sf_dir):
    return res(spark, sf_dir).select(
        "cust_key", "is_valid", F.round("quality_score", 6).alias("quality_score"),
        F.size("issues").cast("long").alias("issue_count"), F.size("warnings").cast("long").alias("warning_count"))


@query(with_blocks(["issues", "checks"], """SELECT i.cust_key, i.field, i.issue_type,
       CASE WHEN i.issue_type = 'out_of_range' THEN split_part(i.description, ' (', 1) ELSE i.description END AS description,
       CASE WHEN i.description LIKE 'Value below minimum%' THEN round(c.min_value, 4) WHEN i.description LIKE 'Value above maximum%' THEN round(c.max_value, 4) END AS bound
       FROM issues i JOIN checks c ON i.cust_key = c.cust_key AND i.field_id = c.field_id"""))
def validation_issues(spark, sf_dir):
    """The bound of a range issue is compared as a number, as its text depends on the last digit of a sum."""
    rows = E.issue_rows(res(spark, sf_dir), ["cust_key"])
    ranged = F.col("issue_type") == "out_of_range"
    bound = F.when(ranged, F.round(F.regexp_extract("description", r"(-?[0-9.]+(?:E-?[0-9]+)?)\)$", 1).try_cast("double"), 4))
    short = F.when(ranged, F.split_part("description", F.lit(" ("), F.lit(1))).otherwise(F.col("description"))
    return rows.withColumns({"bound": bound, "description": short})


@query(with_blocks(["res"], "SELECT cust_key, quality_level FROM res"), name="quality_level")
def quality_level_query(spark, sf_dir):
    return res(spark, sf_dir).select("cust_key", "quality_level")


@query(with_blocks(["res"], """
    SELECT cust_key, 'Data quality score is ' || printf('%.2f', quality_score) || ' - consider reviewing' AS warning FROM res WHERE quality_score < 0.8
    UNION ALL SELECT cust_key, 'Poor data quality detected - manual review recommended' FROM res WHERE quality_score < 0.6"""))
def score_warnings(spark, sf_dir):
    r = res(spark, sf_dir, score_warnings=True)
    return r.select("cust_key", F.explode("warnings").alias("warning")).filter(F.col("warning").rlike("^(Data quality score|Poor data)"))


# ---- splits -----------------------------------------------------------------------------------------
@query(with_blocks(["res", "cleaned"], "SELECT CASE WHEN is_valid THEN 'good' ELSE 'bad' END AS side, c.* FROM res JOIN cleaned c USING (cust_key)"))
def split_good_bad(spark, sf_dir):
    """Both sides from one pass: the side is a column."""
    return res(spark, sf_dir).select(F.when(F.col("is_valid"), "good").otherwise("bad").alias("side"), "cust_key", *X.DIRTY_FIELDS)


@query(with_blocks(["res"], "SELECT cust_key, CASE WHEN is_valid AND quality_score >= 0.95 THEN 'high' ELSE 'low' END AS side FROM res"))
def split_by_quality(spark, sf_dir):
    return res(spark, sf_dir).select("cust_key", F.when(E.is_high_quality(0.95), "high").otherwise("low").alias("side"))


_LEVELS = [name for name, _ in V.LEVELS] + [V.LOWEST_LEVEL]
block("stats", "SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records, "
      + ", ".join(f"count(*) FILTER (WHERE is_valid AND quality_level = '{n}') AS {n}_records" for n in _LEVELS)
      + ", round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_valid) / count(*) * 100 ELSE 0 END, 6) AS success_rate_pct FROM res", ["res"])


@query(with_blocks(["stats"], "SELECT * FROM stats"))
def ingest_stats(spark, sf_dir):
    return rounded(E.ingest_stats(res(spark, sf_dir)), "success_rate_pct")


_ERRORS = "string_agg(field || ': ' || CASE WHEN issue_type = 'out_of_range' THEN 'Value outside range' ELSE description END, '; ' ORDER BY field_id, o)"
block("error_rows", f"""
    SELECT r.cust_key, round(quality_score, 6) AS quality_score, e.errors, coalesce(w.warnings, '') AS warnings
    FROM res r JOIN (SELECT cust_key, {_ERRORS} AS errors FROM (SELECT *, CASE issue_type WHEN 'missing_value' THEN 0 WHEN 'invalid_format' THEN 1
                        WHEN 'length_violation' THEN 2 WHEN 'out_of_range' THEN 3 ELSE 4 END AS o FROM issues) GROUP BY cust_key) e USING (cust_key)
    LEFT JOIN (SELECT cust_key, string_agg(warning, '; ' ORDER BY field_id) AS warnings FROM warns GROUP BY cust_key) w USING (cust_key)
    WHERE NOT is_valid ORDER BY cust_key LIMIT 50""", ["res", "issues", "warns"])


@query(with_blocks(["error_rows"], "SELECT * FROM error_rows"))
def error_detail_topk(spark, sf_dir):
    rows = rounded(E.first_failures(res(spark, sf_dir), ["cust_key"]), "quality_score")
    return rows.withColumn("errors", F.regexp_replace("errors", r"Value (below minimum|above maximum) \([^)]*\)", "Value outside range"))


@query(with_blocks(["issues"], "SELECT issue_type, field, count(*) AS issue_count FROM issues GROUP BY issue_type, field"))
def issues_by_type(spark, sf_dir):
    return E.issues_by_type(res(spark, sf_dir))


@query(with_blocks(["res"], "SELECT cust_key, issue_count, least(issue_count, 1) AS reported FROM res"))
def cap_issues(spark, sf_dir):
    r = E.cap_issues(res(spark, sf_dir), 1)
    return r.select("cust_key", F.col("issue_count").cast("long").alias("issue_count"), F.size("issues").cast("long").alias("reported"))


# ---- constraint check of the inferred definition ------------------------------------------------
_loose = {"integer": "regexp_matches(value, '^\\d+$')", "float": f"({sql_number('value')}) IS NOT NULL",
          "boolean": f"lower(value) IN ({text_list(V.LOOSE_BOOLEAN_WORDS)})",
          "datetime": f"({sql_matches('date', 'value')} OR {sql_matches('datetime', 'value')})",
          "email": "(contains(value, '@') AND contains(value, '.'))", "phone": "length(replace(replace(value, ' ', ''), '-', '')) >= 10",
          "url": "(starts_with(value, 'http://') OR starts_with(value, 'https://'))"}
_cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _loose.items())
block("con_cells", f"""
    SELECT *, required AND (value IS NULL OR value = '') AS missing, value IS NOT NULL AND NOT (CASE detected_type {_cases} ELSE true END) AS mismatch,
           {sql_number('value')} AS x
    FROM (SELECT c.cust_key, c.field_id, c.field, c.value, p.detected_type, p.null_count = 0 AS required, p.min_length, p.max_length, p.min_value, p.max_value,
                 p.is_categorical AND a.value IS NULL AS off_list
          FROM cells c JOIN tprof p USING (field_id) LEFT JOIN tallowed a ON a.field_id = c.field_id AND a.value = c.value)""",
      ["cells", "tprof", "tallowed"])
block("con", """
    SELECT cust_key, sum(score) / count(*) AS quality_score, count(*) FILTER (WHERE missing) AS error_count, count(*) FILTER (WHERE mismatch) AS warning_count
    FROM (SELECT *, CASE WHEN missing THEN 0.0 WHEN value IS NULL THEN 1.0 ELSE
          CAST(CASE WHEN mismatch THEN 0.8 ELSE 1.0 END AS DOUBLE)
          * CAST(CASE WHEN coalesce(length(value) < min_length, false) THEN 0.7 ELSE 1.0 END AS DOUBLE)
          * CAST(CASE WHEN coalesce(length(value) > max_length, false) THEN 0.7 ELSE 1.0 END AS DOUBLE)
          * CAST(CASE WHEN coalesce(x < min_value, false) THEN 0.5 ELSE 1.0 END AS DOUBLE)
          * CAST(CASE WHEN coalesce(x > max_value, false) THEN 0.5 ELSE 1.0 END AS DOUBLE)
          * CAST(CASE WHEN off_list THEN 0.6 ELSE 1.0 END AS DOUBLE) END AS score FROM con_cells)
    GROUP BY cust_key""", ["con_cells"])


def constrained(spark, sf_dir):
    return K.validate_constraints(X.cleaned(spark, sf_dir), R.learn_definition(X.train(spark, sf_dir), X.DIRTY_FIELDS))


@query(with_blocks(["con"], """
    SELECT cust_key, round(quality_score, 6) AS quality_score, error_count, warning_count, error_count = 0 AS is_valid,
           CASE WHEN error_count > 0 THEN 'invalid' WHEN warning_count > 0 THEN 'warning' ELSE 'valid' END AS status FROM con"""))
def validate_constraints(spark, sf_dir):
    return constrained(spark, sf_dir).select(
        "cust_key", F.round("quality_score", 6).alias("quality_score"), F.size("errors").cast("long").alias("error_count"),
        F.size("warnings").cast("long").alias("warning_count"), "is_valid", "status")


@query(with_blocks(["con", "cleaned"], f"""
    SELECT round(sum(quality_score) / count(*), 6) AS overall_quality_score, round(count(*) FILTER (WHERE error_count = 0) / count(*), 6) AS data_completeness,
           (SELECT {' + '.join(f'CAST(count({f}) > 0 AS INTEGER)' for f in X.DIRTY_FIELDS)} FROM cleaned) / {len(X.DIRTY_FIELDS)} AS schema_coverage,
           round(count(*) FILTER (WHERE error_count > 0) / count(*), 6) AS error_rate,
           round(count(*) FILTER (WHERE warning_count > 0) / count(*), 6) AS warning_rate FROM con"""))
def dynamic_quality_metrics(spark, sf_dir):
    return rounded(K.dynamic_metrics(constrained(spark, sf_dir), X.DIRTY_FIELDS),
                   "overall_quality_score", "data_completeness", "error_rate", "warning_rate")


# ---- static customer model ------------------------------------------------------------------------
def _static_failures_sql():
    parts = []
    for name, required, low, high in V.CUSTOMER_MODEL:
        if required:
            parts.append(f"CASE WHEN {name} IS NULL OR length(trim({name})) = 0 THEN '{name}: required' END")
        if low is not None and low > 1:
            parts.append(f"CASE WHEN length(trim({name})) > 0 AND length({name}) < {low} THEN '{name}: too short' END")
        if high is not None:
            parts.append(f"CASE WHEN length({name}) > {high} THEN '{name}: too long' END")
    parts.append("CASE WHEN length(trim(postal_code)) BETWEEN 1 AND 2 THEN 'postal_code: under three characters' END")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


@query(with_blocks(["static"], f"SELECT cust_key, {_static_failures_sql()} AS failures, {_static_failures_sql()} = '' AS is_valid FROM static"))
def validate_static_model(spark, sf_dir):
    return K.validate_static(static_records(spark, sf_dir)).select("cust_key", F.concat_ws("; ", "failures").alias("failures"), "is_valid")


_POINTS = " + ".join(
    [f"CASE WHEN length(trim({c})) > 0 THEN 1 ELSE 0 END" for c in
     ("customer_id", "company_name", "contact_name", "city", "postal_code", "country", "region", "contact_title")]
    + ["CASE WHEN length(customer_id) >= 3 THEN 1 ELSE 0 END", "CASE WHEN length(postal_code) >= 5 THEN 1 ELSE 0 END",
       f"CASE WHEN segment IN ({text_list(V.SEGMENTS)}) THEN 1 ELSE 0 END"])


@query(with_blocks(["static"], f"SELECT cust_key, ({_POINTS}) / 10 AS score, least(1.0, ({_POINTS}) / 10) AS capped_score FROM static"))
def static_quality_score(spark, sf_dir):
    df = static_records(spark, sf_dir)
    score = K.static_score(df)
    return df.select("cust_key", score.alias("score"), F.least(F.lit(1.0), score).alias("capped_score"))


# ---- declared rules, keys and references on ORD ---------------------------------------------------
DECLARED = {
    "OrderID": K.DeclaredField("integer", False),
    "CustomerID": K.DeclaredField("string", False, "^[A-Z0-9]{5}$"),
    "OrderDate": K.DeclaredField("string", False, r"^\d{4}-\d{2}-\d{2}$"),
    "ShippedDate": K.DeclaredField("string", True, r"^\d{4}-\d{2}-\d{2}$"),
    "Freight": K.DeclaredField("float", False),
}


@query(with_blocks(["ord"], """
    SELECT failures, count(*) AS record_count FROM (
        SELECT concat_ws('; ', CASE WHEN NOT regexp_matches("CustomerID", '^[A-Z0-9]{5}$') THEN 'CustomerID: pattern mismatch' END,
                         CASE WHEN "Freight" IS NULL THEN 'Freight: required value missing' END) AS failures FROM ord) GROUP BY failures"""))
def validate_declared_rules(spark, sf_dir):
    checked = K.validate_declared(X.ord_records(spark, sf_dir), DECLARED)
    return checked.groupBy(F.concat_ws("; ", "failures").alias("failures")).agg(F.count(F.lit(1)).alias("record_count"))


@query(with_blocks(["ord"], """SELECT "OrderID", "LineNumber", copies, 'duplicate_value' AS issue_type FROM
    (SELECT *, count(*) OVER (PARTITION BY "OrderID", "LineNumber") AS copies FROM ord) WHERE copies > 1"""))
def validate_primary_key(spark, sf_dir):
    marked = K.mark_duplicates(X.ord_records(spark, sf_dir), ["OrderID", "LineNumber"])
    return marked.filter("copies > 1").select("OrderID", "LineNumber", "copies", F.lit("duplicate_value").alias("issue_type"))


_DISP = """CASE WHEN "CustomerID" IS NULL OR "Freight" IS NULL THEN 'violation'
           WHEN "Freight" < 0 OR "ShippedDate" < "OrderDate" THEN 'quarantine' ELSE 'accepted' END"""


def disposed(spark, sf_dir):
    kind = K.disposition([F.col("CustomerID"), F.col("Freight")], [F.col("Freight") < 0, F.col("ShippedDate") < F.col("OrderDate")])
    return X.ord_records(spark, sf_dir).withColumn("disposition", kind)


@query(with_blocks(["ord"], f'SELECT {_DISP} AS disposition, count(*) AS record_count, round(sum("Freight"), 4) AS freight FROM ord GROUP BY 1'))
def disposition_three_way(spark, sf_dir):
    return disposed(spark, sf_dir).groupBy("disposition").agg(
        F.count(F.lit(1)).alias("record_count"), F.round(F.sum("Freight"), 4).alias("freight"))


@query(with_blocks(["ord"], 'SELECT "OrderID", "LineNumber", "OrderDate", "ShippedDate" FROM ord WHERE "ShippedDate" < "OrderDate"'))
def validate_cross_field(spark, sf_dir):
    late = F.col("ShippedDate") < F.col("OrderDate")
    return X.ord_records(spark, sf_dir).filter(late).select("OrderID", "LineNumber", "OrderDate", "ShippedDate")


CUSTOM = [
    K.CustomRule("CustomerID", "pattern", "^[0-9]{5}$", "customer id must be five digits"),
    K.CustomRule("Freight", "range", (0, 900), "freight out of range"),
    K.CustomRule("LineNumber", "values", ["1", "2", "3", "4", "5", "6"], "unknown line number"),
    K.CustomRule("Freight", "required", None, "freight is required"),
    K.CustomRule("OrderID", "unique", None, "order id repeats"),
]


@query(with_blocks(["ord"], """
    SELECT failures, count(*) AS record_count FROM (
        SELECT concat_ws('; ', CASE WHEN NOT regexp_matches("CustomerID", '^[0-9]{5}$') THEN 'customer id must be five digits' END,
               CASE WHEN NOT ("Freight" BETWEEN 0 AND 900) THEN 'freight out of range' END,
               CASE WHEN "LineNumber" NOT IN (1, 2, 3, 4, 5, 6) THEN 'unknown line number' END,
               CASE WHEN "Freight" IS NULL THEN 'freight is required' END,
               CASE WHEN count(*) OVER (PARTITION BY "OrderID") > 1 THEN 'order id repeats' END) AS failures FROM ord) GROUP BY failures"""))
def validate_custom_rules(spark, sf_dir):
    checked = K.validate_custom(X.ord_records(spark, sf_dir), CUSTOM)
    return checked.groupBy(F.concat_ws("; ", "failures").alias("failures")).agg(F.count(F.lit(1)).alias("record_count"))


@query("""SELECT ref AS supplier_ref, count(*) AS row_count FROM (SELECT CASE WHEN l_partkey % 53 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS ref FROM lineitem)
          WHERE ref NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ref""")
def validate_foreign_key(spark, sf_dir):
    broken = F.when(F.col("l_partkey") % 53 == 0, F.col("l_suppkey") + 1000000).otherwise(F.col("l_suppkey"))
    lines = X.read_table(spark, sf_dir, "lineitem").select(broken.alias("supplier_ref"))
    return K.orphans(lines, "supplier_ref", X.read_table(spark, sf_dir, "supplier"), "s_suppkey")


@query(with_blocks(["checks"], f"""
    SELECT cust_key, 'outlier' AS issue_type FROM (SELECT c.cust_key, {sql_number('c.value')} AS x, p.mean_value, p.std_value
        FROM cells c JOIN tprof p USING (field_id) WHERE c.field = 'balance') WHERE x < mean_value - 2 * std_value OR x > mean_value + 2 * std_value"""))
def validate_outlier(spark, sf_dir):
    row = P.profile(X.train(spark, sf_dir), ["balance"]).select("mean_value", "std_value").first()
    df = X.cleaned(spark, sf_dir)
    far = K.outside_spread(number(as_text(df, "balance")), row["mean_value"], row["std_value"])
    return df.filter(far).select("cust_key", F.lit("outlier").alias("issue_type"))


def _repeated(spark, sf_dir):
    """Order lines, every hundredth order's twice; whole records."""
    lines = X.read_table(spark, sf_dir, "lineitem")
    return lines.unionByName(lines.filter(F.col("l_orderkey") % 100 == 0))


_REPEATED = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 0)"


@query(f"SELECT *, count(*) AS copies FROM {_REPEATED} GROUP BY ALL HAVING count(*) > 1")
def duplicate_records(spark, sf_dir):
    return K.duplicate_records(_repeated(spark, sf_dir))


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS distinct_records, round(count(*) / sum(n), 6) AS uniqueness
           FROM (SELECT n FROM (SELECT *, count(*) AS n FROM {_REPEATED} GROUP BY ALL))""")
def record_uniqueness(spark, sf_dir):
    return rounded(K.uniqueness(_repeated(spark, sf_dir)), "uniqueness")


@query(f"""SELECT o_orderkey, greatest(0.0, least(1.0, 2.0 - date_diff('day', CAST(o_orderdate AS DATE), DATE '{NOW[:10]}') / 1000)) AS timeliness FROM orders""")
def timeliness(spark, sf_dir):
    fresh = K.timeliness(F.col("o_orderdate").cast("date"), X.now().cast("date"), 1000)
    return X.read_table(spark, sf_dir, "orders").select("o_orderkey", fresh.alias("timeliness"))


# ---- insights and the report ------------------------------------------------------------------------
block("worst_field", "SELECT field AS worst_field, count(*) AS worst_field_issues FROM issues JOIN res USING (cust_key) WHERE NOT is_valid GROUP BY field ORDER BY 2 DESC, 1 LIMIT 1", ["issues", "res"])
block("types", "SELECT detected_type, count(*) AS n FROM tprof GROUP BY detected_type", ["tprof"])
block("insight_rows", """
    SELECT unnest(list_filter([
        'Automatically detected ' || (SELECT sum(n) FROM types) || ' fields with ' || (SELECT count(*) FROM types) || ' different data types',
        'Most common data type: ' || (SELECT detected_type || ' (' || n || ' fields)' FROM types ORDER BY n DESC, detected_type LIMIT 1),
        CASE WHEN success_rate_pct >= 95 THEN 'Excellent data quality - very high success rate with intelligent validation'
             WHEN success_rate_pct >= 80 THEN 'Good data quality - acceptable success rate' WHEN success_rate_pct >= 60 THEN 'Fair data quality - consider data source review'
             ELSE 'Poor data quality - immediate attention required' END,
        CASE WHEN excellent_records / valid_records >= 0.8 THEN 'Majority of valid records have excellent quality scores'
             WHEN poor_records / valid_records >= 0.3 THEN 'High percentage of poor quality records among valid data' END,
        'Most problematic field: ''' || worst_field || ''' with ' || worst_field_issues || ' validation issues'], lambda x: x IS NOT NULL)) AS insight
    FROM stats LEFT JOIN worst_field ON true""", ["stats", "worst_field", "types"])


def insight_summary(stats, issues, rules):
    """One row: stats, the types of the learned rules and the field with most issues."""
    kinds: dict[str, int] = {}
    for r in rules:
        kinds[r.kind] = kinds.get(r.kind, 0) + 1
    top = min(kinds.items(), key=lambda kv: (-kv[1], kv[0]))
    worst = issues.groupBy("field").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("worst_field_issues"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("field").alias("f"))).alias("best"))
    one = worst.select(F.col("best.f").alias("worst_field"), "worst_field_issues")
    return stats.crossJoin(one).select(  # both sides are one row
        "*", F.lit(len(rules)).alias("fields"), F.lit(len(kinds)).alias("types"), F.lit(top[0]).alias("top_type"),
        F.lit(top[1]).alias("top_type_fields"))


@query(with_blocks(["insight_rows"], "SELECT insight FROM insight_rows"))
def insights(spark, sf_dir):
    rules = learned(spark, sf_dir)
    r = E.validate(X.cleaned(spark, sf_dir), rules, ["cust_key"])
    return I.validator_insights(insight_summary(E.ingest_stats(r), E.issue_rows(E.bad(r), []), rules)).select("insight")


@query(with_blocks(["stats", "types", "error_rows", "insight_rows"], f"""
    SELECT 'summary' AS section, 'total_records' AS name, CAST(total_records AS VARCHAR) AS value FROM stats
    UNION ALL SELECT 'summary', 'valid_records', CAST(valid_records AS VARCHAR) FROM stats
    UNION ALL SELECT 'summary', 'invalid_records', CAST(invalid_records AS VARCHAR) FROM stats
    UNION ALL {' UNION ALL '.join(f"SELECT 'quality_distribution', '{n}', CAST({n}_records AS VARCHAR) FROM stats" for n in _LEVELS)}
    UNION ALL SELECT 'schema', detected_type, CAST(n AS VARCHAR) FROM types
    UNION ALL SELECT 'error', CAST(cust_key AS VARCHAR), errors FROM error_rows
    UNION ALL SELECT 'insight', 'insight', insight FROM insight_rows"""))
def validation_report(spark, sf_dir):
    """The parts of a validation report in one frame."""
    rules = learned(spark, sf_dir)
    path = work_path(spark, "report")  # read five times, so it is kept as a table that outlives a lost executor
    E.validate(X.cleaned(spark, sf_dir), rules, ["cust_key"]).write.parquet(path)
    r = spark.read.parquet(path)
    stats = E.ingest_stats(r)
    names = ["total_records", "valid_records", "invalid_records"]
    text = stats.select(*[F.col(c).cast("string").alias(c) for c in stats.columns])
    summary = text.unpivot([], names, "name", "value").select(F.lit("summary").alias("section"), "name", "value")
    spread = text.unpivot([], [f"{n}_records" for n in _LEVELS], "name", "value").select(
        F.lit("quality_distribution").alias("section"), F.regexp_replace("name", "_records$", "").alias("name"), "value")
    kinds = P.profile(X.train(spark, sf_dir), X.DIRTY_FIELDS).groupBy("detected_type").agg(F.count(F.lit(1)).cast("string").alias("value"))
    errors = E.first_failures(r, ["cust_key"]).select(
        F.lit("error").alias("section"), F.col("cust_key").cast("string").alias("name"),
        F.regexp_replace("errors", r"Value (below minimum|above maximum) \([^)]*\)", "Value outside range").alias("value"))
    found = I.validator_insights(insight_summary(stats, E.issue_rows(E.bad(r), []), rules))
    return (
        summary.unionByName(spread)
        .unionByName(kinds.select(F.lit("schema").alias("section"), F.col("detected_type").alias("name"), "value"))
        .unionByName(errors)
        .unionByName(found.select(F.lit("insight").alias("section"), F.lit("insight").alias("name"), F.col("insight").alias("value")))
    )
