"""Queries: profiling, rules, dimension scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import profile as P
from ..operators import rules as R
from ..operators import validate as E
from . import fixtures as X
from .catalog import query
from .ctes import histogram_block, profile_blocks, sql_level, with_blocks


def rounded(df, *names: str, places: int = 6):
    """Round doubles so that engines that add in another order agree."""
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def _profile(spark, sf_dir):
    return P.profile(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)


_BASIC = "field, total_values::BIGINT AS total_values, null_count::BIGINT AS null_count, unique_values, nullable"


@query(with_blocks(["dprof"], f"SELECT {_BASIC} FROM dprof"))
def profile_basic(spark, sf_dir):
    return P.profile_basic(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)


#: a sketch may miss a count by five of its standard errors
_BOUND = 0.1


def _near(spark, sf_dir, rows):
    """Whether each sketched number of distinct values lies within the bound of the exact one."""
    exact = P.profile_basic(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS).select("field", F.col("unique_values").alias("exact"))
    near = F.abs(F.col("unique_values") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * _BOUND)
    return rows.join(exact, "field").withColumn("distinct_near", near).drop("exact", "unique_values")


@query(with_blocks(["dprof"], "SELECT field, detected_type, total_values::BIGINT AS total_values, null_count::BIGINT AS null_count, nullable, "
                   + ", ".join(f"round({c}, 6) AS {c}" for c in ("min_value", "max_value", "mean_value", "std_value")) + ", true AS distinct_near FROM dprof"))
def infer_schema_approx(spark, sf_dir):
    """The sketched form: all but the number of distinct values is exact."""
    rows = P.profile_approx(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)
    numbers = ["min_value", "max_value", "mean_value", "std_value"]
    return _near(spark, sf_dir, rounded(rows, *numbers).select("field", "detected_type", "total_values", "null_count", "unique_values", "nullable", *numbers))


@query(with_blocks(["dprof"], "SELECT field, total_values::BIGINT AS total_values, null_count::BIGINT AS null_count, nullable, true AS distinct_near FROM dprof"))
def profile_basic_approx(spark, sf_dir):
    return _near(spark, sf_dir, P.profile_basic_approx(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS))


@query(with_blocks(["dhist"], """
    SELECT field, value, CAST(row_number() OVER (PARTITION BY field_id ORDER BY value) AS INTEGER) AS position FROM dhist
    WHERE value IS NOT NULL QUALIFY position <= 10"""))
def profile_samples(spark, sf_dir):
    return P.sample_values(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)


@query(with_blocks(["dprof"], "SELECT field, CAST(min_length AS INTEGER) AS min_length, CAST(max_length AS INTEGER) AS max_length, round(avg_length, 6) AS avg_length FROM dprof"))
def profile_lengths(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).select("field", "min_length", "max_length", "avg_length"), "avg_length")


_NUM = ["min_value", "max_value", "mean_value", "std_value"]


@query(with_blocks(["dprof"], "SELECT field, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUM) + " FROM dprof"))
def profile_numeric(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).select("field", *_NUM), *_NUM)


@query(with_blocks(["dprof", "sprof"], "SELECT field, is_categorical FROM dprof UNION ALL SELECT field, is_categorical FROM sprof"))
def profile_categorical_flag(spark, sf_dir):
    a = _profile(spark, sf_dir).select("field", "is_categorical")
    return a.unionByName(P.profile(X.samples(spark, sf_dir), X.SAMPLE_FIELDS).select("field", "is_categorical"))


@query(with_blocks(["dhist", "dprof"], """
    SELECT h.field, h.value AS category, h.n AS frequency,
           CAST(row_number() OVER (PARTITION BY h.field_id ORDER BY h.n DESC, h.value) AS INTEGER) AS position
    FROM dhist h JOIN dprof p USING (field_id) WHERE p.is_categorical AND h.value IS NOT NULL QUALIFY position <= 20"""))
def profile_top_categories(spark, sf_dir):
    return P.top_categories(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)


_SCORES = ["completeness", "consistency", "validity", "overall_quality"]
_SCORES_SQL = ("round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(validity, 6) AS validity, "
               "round((completeness + consistency + validity) / 3, 6) AS overall_quality")


@query(with_blocks(["dprof", "sprof"], f"SELECT field, {_SCORES_SQL} FROM (SELECT * FROM dprof UNION ALL SELECT * FROM sprof)"))
def profile_scores(spark, sf_dir):
    a = _profile(spark, sf_dir).select("field", *_SCORES)
    b = P.profile(X.samples(spark, sf_dir), X.SAMPLE_FIELDS).select("field", *_SCORES)
    return rounded(a.unionByName(b), *_SCORES)


_RULE_SQL = """field, kind AS detected_type, required, CAST(min_length AS INTEGER) AS min_length, CAST(max_length AS INTEGER) AS max_length,
               round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, categorical"""


@query(with_blocks(["trules", "tallowed"], f"""
    SELECT {_RULE_SQL}, coalesce(a.allowed, '') AS allowed
    FROM trules LEFT JOIN (SELECT field_id, string_agg(value, '|' ORDER BY value) AS allowed FROM tallowed GROUP BY field_id HAVING count(*) <= {V.RULE_VALUES}) a USING (field_id)"""))
def profile_rules(spark, sf_dir):
    rows = R.rule_rows(P.with_categories(X.train(spark, sf_dir), X.DIRTY_FIELDS))
    flat = rows.select("field", "detected_type", "required", "min_length", "max_length", "min_value", "max_value", "categorical",
                       F.coalesce(F.array_join(F.sort_array("categories"), "|"), F.lit("")).alias("allowed"))
    return rounded(flat, "min_value", "max_value")


_SCHEMA_SQL = f"""SELECT field, detected_type, total_values::BIGINT AS total_values, null_count::BIGINT AS null_count, unique_values, nullable,
    CAST(min_length AS INTEGER) AS min_length, CAST(max_length AS INTEGER) AS max_length, round(avg_length, 6) AS avg_length,
    {', '.join(f'round({c}, 6) AS {c}' for c in _NUM)}, is_categorical, {_SCORES_SQL}"""


def _schema(df, columns):
    return rounded(P.profile(df, columns).drop(P.ID), "avg_length", *_NUM, *_SCORES)


@query(with_blocks(["dprof"], f"{_SCHEMA_SQL} FROM dprof"))
def infer_schema(spark, sf_dir):
    return _schema(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)


# the same over other tables, as text where a double would print differently
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "placed", "o_orderpriority"]
X.block("orders_text", """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
                          strftime(o_orderdate, '%Y-%m-%d') AS placed, o_orderpriority FROM orders""")
histogram_block("ohist", "orders_text", _ORDER_COLUMNS)
profile_blocks("oprof", "ohist")


def orders_text(spark, sf_dir):
    return X.read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"), "o_orderpriority")


@query(with_blocks(["oprof"], f"{_SCHEMA_SQL} FROM oprof"))
def infer_schema_orders(spark, sf_dir):
    return _schema(orders_text(spark, sf_dir), _ORDER_COLUMNS)


_EVENT_COLUMNS = ["event_id", "seen_at", "user_id", "event_type", "amount", "props"]
X.block("events_text", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at, user_id, event_type,
                          CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount, props FROM events""")
histogram_block("ehist", "events_text", _EVENT_COLUMNS)
profile_blocks("eprof", "ehist")


def events_text(spark, sf_dir):
    return X.read_table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "user_id", "event_type",
        F.col("value").cast("decimal(18,2)").alias("amount"), "props")


@query(with_blocks(["eprof"], f"{_SCHEMA_SQL} FROM eprof"))
def infer_schema_events(spark, sf_dir):
    return _schema(events_text(spark, sf_dir), _EVENT_COLUMNS)


_DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
histogram_block("dochist", "documents", _DOCUMENT_COLUMNS)
profile_blocks("docprof", "dochist")


@query(with_blocks(["docprof"], f"{_SCHEMA_SQL} FROM docprof"))
def infer_schema_documents(spark, sf_dir):
    """A table of long text: whole values are profiled, hashes are moved."""
    rows = P.profile(X.read_table(spark, sf_dir, "documents"), _DOCUMENT_COLUMNS, compact_over=256)
    return rounded(rows.drop(P.ID), "avg_length", *_NUM, *_SCORES)


profile_blocks("nprof", "ohist", V.TYPE_ORDER_NUMERIC_FIRST)


@query(with_blocks(["nprof"], "SELECT field, detected_type FROM nprof"))
def detect_types_numeric_first(spark, sf_dir):
    return P.profile(orders_text(spark, sf_dir), _ORDER_COLUMNS, V.TYPE_ORDER_NUMERIC_FIRST).select("field", "detected_type")


@query(with_blocks(["sprof", "dprof"], f"""
    SELECT 'field_type' AS section, detected_type AS name, count(*) AS fields FROM (SELECT * FROM dprof UNION ALL SELECT * FROM sprof) GROUP BY detected_type
    UNION ALL SELECT 'quality_band', {sql_level('(completeness + consistency + validity) / 3')}, count(*)
    FROM (SELECT * FROM dprof UNION ALL SELECT * FROM sprof) GROUP BY 2"""))
def schema_summary(spark, sf_dir):
    rows = _profile(spark, sf_dir).unionByName(P.profile(X.samples(spark, sf_dir), X.SAMPLE_FIELDS))
    return P.schema_summary(rows)


_FILLED = "value IS NOT NULL AND value <> ''"

histogram_block("rawhist", "dirty", X.DIRTY_FIELDS)
X.block("metrics", f"""
    SELECT field, coalesce(sum(n) FILTER (WHERE {_FILLED}), 0) / sum(n) AS completeness,
           coalesce(count(*) FILTER (WHERE {_FILLED}) / nullif(sum(n) FILTER (WHERE {_FILLED}), 0), 0) AS uniqueness,
           (sum(n) - coalesce(sum(n) FILTER (WHERE {_FILLED}), 0)) / sum(n) AS null_rate
    FROM rawhist GROUP BY field""", ["rawhist"])


@query(with_blocks(["metrics"], "SELECT field, round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(null_rate, 6) AS null_rate FROM metrics"))
def field_metrics(spark, sf_dir):
    return rounded(P.field_metrics(X.dirty(spark, sf_dir), X.DIRTY_FIELDS), "completeness", "uniqueness", "null_rate")


@query(with_blocks(["metrics", "dprof"], """
    SELECT p.field, round(0.3 * m.completeness + 0.4 * p.validity + 0.2 * p.consistency + 0.1 * m.uniqueness, 6) AS weighted_score
    FROM dprof p JOIN metrics m ON m.field = p.field"""))
def weighted_quality(spark, sf_dir):
    metrics = P.field_metrics(X.dirty(spark, sf_dir), X.DIRTY_FIELDS).select("field", F.col("completeness").alias("filled"), "uniqueness")
    rows = _profile(spark, sf_dir).join(F.broadcast(metrics), "field")  # one row per column
    score = P.weighted_quality(F.col("filled"), F.col("validity"), F.col("consistency"), F.col("uniqueness"))
    return rows.select("field", F.round(score, 6).alias("weighted_score"))


@query(with_blocks(["dprof", "dhist"], """
    SELECT p.field, p.detected_type, p.nullable, round((completeness + consistency + validity) / 3, 6) AS quality_score, s.sample_values
    FROM dprof p JOIN (SELECT field_id, string_agg(value, '|' ORDER BY value) AS sample_values FROM (
        SELECT field_id, value FROM dhist WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY value) <= 3)
        GROUP BY field_id) s USING (field_id)"""))
def schema_info_view(spark, sf_dir):
    df = X.cleaned(spark, sf_dir)
    hist = P.histogram(df, X.DIRTY_FIELDS)
    few = P.top_values(hist, 3, by_value=True).groupBy(P.ID).agg(  # three values per column
        F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values"))
    rows = P.profile(df, X.DIRTY_FIELDS, hist=hist).join(F.broadcast(few), P.ID, "left")
    return rows.select("field", "detected_type", "nullable", F.round("overall_quality", 6).alias("quality_score"), "sample_values")


# ---- learn on the training rows, judge all ------------------------------------------------------
@query(with_blocks(["res"], """
    SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records, round(avg(quality_score), 6) AS avg_quality_score FROM res"""))
def learn_then_validate(spark, sf_dir):
    """Rules from all training rows and all fields, applied to all records."""
    rules = R.learn_rules(X.train(spark, sf_dir), X.DIRTY_FIELDS)
    res = E.validate(X.cleaned(spark, sf_dir), rules, ["cust_key"])
    return res.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_valid").alias("valid_records"),
                   F.round(F.avg("quality_score"), 6).alias("avg_quality_score"))
