"""Column profiling from one (column, value, count) histogram.

``histogram`` is the only step that moves data: one exchange on (column, value), already combined
on the map side, so a value that fills a third of the rows arrives as one row per task. Every
statistic is then a weighted aggregate over it, each pattern runs once per distinct value, and the
second exchange carries one row per column and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.detectors import DETECTORS, as_text, number
from ..functions.settle import settle

ID = "field_id"


def _names(columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(ID) + 1)


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field_id, value``: every cell as text."""
    return df.select(F.posexplode(F.array(*[as_text(df, c) for c in columns])).alias(ID, "value"))


def count_cells(df: DataFrame, columns: list[str], **conditions: Column) -> DataFrame:
    """Cells per column that meet each condition on ``value``; combined before the exchange."""
    return cells(df, columns).groupBy(ID).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()]
    ).select(_names(columns).alias("field"), "total", *conditions)


def histogram(df: DataFrame, columns: list[str] | None = None, compact_over: int | None = None) -> DataFrame:
    """``field_id, value, n`` for every distinct value; null is one of the values.

    With ``compact_over`` a longer value travels as its SHA-256, together with what profiling needs
    of it (``mark``: length, number, matching types, all taken from the whole value). Use it for
    columns of long text, which would otherwise be moved as they are.
    """
    columns = columns or df.columns
    each, keys = cells(df, columns), [ID, "value"]
    if compact_over is not None:
        value = F.col("value")
        long = F.length(value) > compact_over
        kinds = reduce(lambda a, b: a.bitwiseOR(b), [
            F.when(fn(value), F.lit(1 << i)).otherwise(F.lit(0)) for i, fn in enumerate(DETECTORS.values())])
        mark = F.struct(F.length(value).alias("size"), number(value).alias("x"), kinds.alias("kinds"))
        each = each.select(ID, F.when(long, F.sha2(value, 256)).otherwise(value).alias("value"), F.when(long, mark).alias("mark"))
        keys = [*keys, "mark"]
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _of_value(hist: DataFrame, part: str, plain: Column) -> Column:
    """A property of the value: from its mark if it travels as a hash, else computed."""
    return F.when(F.col("mark").isNotNull(), F.col(f"mark.{part}")).otherwise(plain) if "mark" in hist.columns else plain


def _is_kind(hist: DataFrame, kind: str) -> Column:
    plain = DETECTORS[kind](F.col("value"))
    if "mark" not in hist.columns:
        return plain
    bit = 1 << list(DETECTORS).index(kind)
    return F.when(F.col("mark").isNotNull(), F.col("mark.kinds").bitwiseAND(bit) != 0).otherwise(plain)


def _weighted(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))


def _summaries(hist: DataFrame, *extra: Column) -> DataFrame:
    value, n = F.col("value"), F.col("n")
    sized = hist.select(
        ID, "value", "n",
        *(["mark"] if "mark" in hist.columns else []),
        _of_value(hist, "size", F.length(value)).alias("size"),
        _of_value(hist, "x", number(value)).alias("x"),
    )
    return sized.groupBy(ID).agg(
        F.sum("n").alias("total_values"),
        _weighted(value.isNull()).alias("null_count"),
        *(extra or [F.count("value").alias("unique_values")]),
        F.min("size").alias("min_length"),
        F.max("size").alias("max_length"),
        F.sum(F.col("size") * n).alias("sum_length"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.sum(F.col("x") * n).alias("sum_value"),
        _weighted(F.col("x").isNotNull()).alias("numbers"),
        *[_weighted(_is_kind(hist, t)).alias(f"is_{t}") for t in DETECTORS],
        _weighted(_is_kind(hist, "date") | _is_kind(hist, "datetime")).alias("is_temporal"),
    )


def _spread(hist: DataFrame, base: DataFrame) -> DataFrame:
    """Sum of squared distances from the mean; a second pass keeps it stable for large values."""
    means = base.select(ID, (F.col("sum_value") / F.when(F.col("numbers") > 0, F.col("numbers"))).alias("mean"))
    # one row per column of the table, so the broadcast cannot grow with the data
    joined = hist.select(ID, "n", _of_value(hist, "x", number(F.col("value"))).alias("x")).join(F.broadcast(means), ID)
    gap = F.col("x") - F.col("mean")
    sums = joined.groupBy(ID).agg(
        F.sum(gap * gap * F.col("n")).alias("squares"), F.sum(gap * F.col("n")).alias("rest"), _weighted(gap.isNotNull()).alias("m"))
    # the rounded mean is a little off; the rest of the gaps puts that right
    return sums.select(ID, F.greatest(F.col("squares") - F.try_divide(F.col("rest") * F.col("rest"), F.col("m")), F.lit(0.0)).alias("square_gaps"))


def resolve_type(order: list[str] | None = None, filled: str = "filled", distinct: str = "unique_values") -> Column:
    """Best type of a column from its ``is_<type>`` counts; the earlier type of ``order`` wins a tie."""
    hits = {t: f"is_{t}" for t in DETECTORS}
    hits["categorical"] = (f"IF(try_divide({distinct}, {filled}) < {V.CATEGORY_RATIO}D AND {distinct} < {V.CATEGORY_DISTINCT}, {filled}, 0L)")
    ranked = ", ".join(f"struct({hits[t]} AS hits, {-i} AS rank, '{t}' AS kind)" for i, t in enumerate(order or V.TYPE_ORDER))
    return F.expr(f"""
        transform(array(array_max(array({ranked}))),
                  best -> IF({filled} > 0 AND best.hits > 0 AND best.hits / {filled} >= {V.TYPE_ACCEPTANCE}D, best.kind, 'string'))[0]""")


def profile(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None,
            hist: DataFrame | None = None, compact_over: int | None = None) -> DataFrame:
    """One row per column: counts, resolved type, lengths, numbers, flags and scores."""
    columns = columns or df.columns
    hist = histogram(df, columns, compact_over) if hist is None else hist
    base = _summaries(hist)
    rows = base.join(F.broadcast(_spread(hist, base)), ID, "left")
    return _finish(rows, columns, order)


def _finish(rows: DataFrame, columns: list[str], order: list[str] | None) -> DataFrame:
    """Types, flags and scores of the summed-up columns: a few rows, written as SQL text to keep the plan short."""

    def listed(words: list[str]) -> str:
        return ", ".join(f"'{w}'" for w in words)

    typed = settle(rows.withColumn("filled", F.expr("total_values - null_count")), {"detected_type": resolve_type(order)})
    sized = f"detected_type IN ({listed(V.LENGTH_TYPES)}) AND filled > 0"
    numeric = f"detected_type IN ({listed(V.NUMERIC_TYPES)}) AND numbers > 0"
    matched = " ".join(f"WHEN '{t}' THEN is_{t} / filled" for t in V.PATTERNS)
    scored = typed.select(
        ID, _names(columns).alias("field"), "detected_type", "total_values", "null_count", "unique_values",
        F.expr("null_count > 0").alias("nullable"),
        F.expr(f"IF({sized}, min_length, NULL)").alias("min_length"),
        F.expr(f"IF({sized}, max_length, NULL)").alias("max_length"),
        F.expr(f"IF({sized}, sum_length / filled, NULL)").alias("avg_length"),
        F.expr(f"IF({numeric}, min_value, NULL)").alias("min_value"),
        F.expr(f"IF({numeric}, max_value, NULL)").alias("max_value"),
        F.expr(f"IF({numeric}, sum_value / numbers, NULL)").alias("mean_value"),
        F.expr(f"IF({numeric} AND numbers > 1, sqrt(square_gaps / (numbers - 1)), NULL)").alias("std_value"),
        F.expr(f"filled > 0 AND unique_values / total_values < {V.CATEGORY_RATIO}D").alias("is_categorical"),
        F.expr("IF(filled > 0, filled / total_values, 0D)").alias("completeness"),
        F.expr(f"IF(filled > 0, CASE detected_type {matched} ELSE 1D END, 0D)").alias("consistency"),
        F.expr("""IF(filled > 0, CASE detected_type WHEN 'integer' THEN is_integer / filled WHEN 'float' THEN numbers / filled
                  WHEN 'boolean' THEN is_boolean / filled WHEN 'date' THEN is_temporal / filled
                  WHEN 'datetime' THEN is_temporal / filled ELSE 1D END, 0D)""").alias("validity"),
    )
    return scored.withColumn("overall_quality", F.expr("(completeness + consistency + validity) / 3"))


def profile_approx(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """``profile`` with sketched distinct counts, for tables whose columns hardly repeat.

    The cells are combined straight into one row per column and task: no exchange grows with the
    data, at the price of running the patterns on every cell.
    """
    columns = columns or df.columns
    each = cells(df, columns).withColumn("n", F.lit(1).cast("long"))
    squares = F.var_samp("x") * (F.count("x") - 1)
    rows = _summaries(each, F.approx_count_distinct("value", rsd).alias("unique_values"), squares.alias("square_gaps"))
    return _finish(rows, columns, order)


def profile_basic(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Totals, nulls and distinct counts only."""
    columns = columns or df.columns
    rows = histogram(df, columns).groupBy(ID).agg(
        F.sum("n").alias("total_values"),
        _weighted(F.col("value").isNull()).alias("null_count"),
        F.count("value").alias("unique_values"),
    )
    return rows.select(
        _names(columns).alias("field"), "total_values", "null_count", "unique_values",
        (F.col("null_count") > 0).alias("nullable"),
    )


def profile_basic_approx(df: DataFrame, columns: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """``profile_basic`` with sketched distinct counts: a single pass without a data-sized exchange."""
    columns = columns or df.columns
    wide = df.select(*[as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(f"c{i}").alias(f"f{i}") for i in range(len(columns))],
        *[F.approx_count_distinct(f"c{i}", rsd).alias(f"u{i}") for i in range(len(columns))],
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col("total").alias("total_values"),
                 (F.col("total") - F.col(f"f{i}")).alias("null_count"), F.col(f"u{i}").alias("unique_values"),
                 (F.col("total") > F.col(f"f{i}")).alias("nullable"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(entries))


def top_values(hist: DataFrame, k: int, by_value: bool = False, fields: DataFrame | None = None) -> DataFrame:
    """The ``k`` most frequent (or smallest) values per column with their rank.

    The rank filter lets Spark keep only ``k`` rows per column in each task before the exchange.
    ``fields`` (one row per column) restricts the columns. Nothing here can be pushed into the
    histogram: nulls are ranked last and dropped at the end, and the restriction is an inner join.
    So every reader of the histogram shares one exchange instead of scanning the source again.
    """
    if "mark" in hist.columns:
        raise ValueError("a compacted histogram has hashes in place of long values; take values from a plain one")
    kept = hist if fields is None else hist.join(F.broadcast(fields.select(ID)), ID)
    order = [F.col("value").isNull(), *([] if by_value else [F.col("n").desc()]), F.col("value")]
    ranked = kept.withColumn("position", F.row_number().over(Window.partitionBy(ID).orderBy(*order)))
    return ranked.filter((F.col("position") <= k) & F.col("value").isNotNull())


def categorical_fields(hist: DataFrame) -> DataFrame:
    """Columns with few distinct values. A column of type categorical is always one of them, so no type is needed."""
    counts = hist.groupBy(ID).agg(F.sum("n").alias("total"), F.count("value").alias("distinct"))
    return counts.filter((F.col("distinct") > 0) & (F.col("distinct") / F.col("total") < V.CATEGORY_RATIO))


def top_categories(df: DataFrame, columns: list[str] | None = None, k: int = V.TOP_CATEGORIES) -> DataFrame:
    """Top values with frequencies for the categorical columns."""
    columns = columns or df.columns
    hist = histogram(df, columns)
    return top_values(hist, k, fields=categorical_fields(hist)).select(
        _names(columns).alias("field"), F.col("value").alias("category"), F.col("n").alias("frequency"), "position",
    )


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = V.SAMPLE_VALUES) -> DataFrame:
    """The ``k`` smallest distinct values per column: the same on every run."""
    columns = columns or df.columns
    return top_values(histogram(df, columns), k, by_value=True).select(
        _names(columns).alias("field"), "value", "position")


def with_categories(df: DataFrame, columns: list[str] | None = None, k: int = V.RULE_VALUES,
                    order: list[str] | None = None) -> DataFrame:
    """``profile`` plus the categories of columns with at most ``k`` of them: everything rules are made from.

    The list is complete or absent: a list cut short would make rare but valid values look wrong.
    """
    columns = columns or df.columns
    hist = histogram(df, columns)
    base = profile(df, columns, order, hist=hist)
    tops = (
        top_values(hist, k, fields=categorical_fields(hist).filter(F.col("distinct") <= k))
        .groupBy(ID)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("categories"))
    )
    return base.join(F.broadcast(tops), ID, "left")


def many_valued(df: DataFrame, columns: list[str], rsd: float = 0.02) -> list[str]:
    """Columns that certainly have too many distinct values to be categorical, from one pass of sketches.

    The sketch has to exceed the limit by five of its standard errors, so no column near the limit is
    taken for one of them. One row reaches the driver.
    """
    texts = df.select(*[as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    seen = texts.agg(F.count(F.lit(1)).alias("total"), *[F.approx_count_distinct(f"c{i}", rsd).alias(f"u{i}") for i in range(len(columns))]).first()
    return [c for i, c in enumerate(columns) if seen[f"u{i}"] > (1 + 5 * rsd) * V.CATEGORY_RATIO * seen["total"] > 0]


def rule_profile(df: DataFrame, columns: list[str], k: int = V.RULE_VALUES, order: list[str] | None = None) -> DataFrame:
    """What rules are made from, without moving the values of columns that hardly repeat.

    Columns that a sketch shows to be many-valued are profiled in one pass without a data-sized
    exchange; only the others get an exact histogram. Types, bounds and lists do not depend on which
    way a column took.
    """
    many = set(many_valued(df, columns))
    few = [c for c in columns if c not in many]
    parts = [with_categories(df, few, k, order)] if few else []
    if many:
        wide = profile_approx(df, [c for c in columns if c in many], order)
        parts.append(wide.withColumn("categories", F.lit(None).cast("array<string>")))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("field")).cast("int") - 1
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn(ID, place)


def field_metrics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Completeness, uniqueness and null rate per column; an empty text counts as null."""
    columns = columns or df.columns
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    rows = histogram(df, columns).groupBy(ID).agg(
        F.sum("n").alias("total"), _weighted(filled).alias("filled"),
        F.count(F.when(filled, F.lit(1))).alias("distinct"),
    )
    return rows.select(
        _names(columns).alias("field"),
        (F.col("filled") / F.col("total")).alias("completeness"),
        F.when(F.col("filled") > 0, F.col("distinct") / F.col("filled")).otherwise(0.0).alias("uniqueness"),
        ((F.col("total") - F.col("filled")) / F.col("total")).alias("null_rate"),
    )


def schema_summary(profiled: DataFrame) -> DataFrame:
    """Columns per type and per quality band, in long form."""
    from ..functions.detectors import quality_level

    types = profiled.groupBy(F.lit("field_type").alias("section"), F.col("detected_type").alias("name")).agg(
        F.count(F.lit(1)).alias("fields"))
    bands = profiled.groupBy(
        F.lit("quality_band").alias("section"), quality_level(F.col("overall_quality")).alias("name")
    ).agg(F.count(F.lit(1)).alias("fields"))
    return types.unionByName(bands)


def weighted_quality(completeness: Column, validity: Column, consistency: Column, uniqueness: Column) -> Column:
    """Dimension score with the documented weights."""
    return 0.3 * completeness + 0.4 * validity + 0.2 * consistency + 0.1 * uniqueness
