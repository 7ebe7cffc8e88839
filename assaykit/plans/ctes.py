"""SQL building blocks shared by the oracle queries; each is one common table expression."""

from __future__ import annotations

from ..functions import fixed_values as V

NOW = "2001-08-02 00:00:00"

# name -> (blocks it reads, body)
BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, body: str, uses: list[str] | None = None) -> None:
    BLOCKS[name] = (uses or [], body)


def with_blocks(uses: list[str], body: str) -> str:
    """``body`` behind a WITH clause holding the blocks it needs, dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for other in BLOCKS[name][0]:
                visit(other)
            done.append(name)

    for name in uses:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in done) + "\n" + body


def text_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_matches(kind: str, value: str) -> str:
    """The type predicate of ``kind`` in SQL."""
    if kind in V.PATTERNS:
        return "(" + " OR ".join(f"regexp_matches({value}, '(?i){p}')" for p in V.PATTERNS[kind]) + ")"
    return {
        "integer": f"regexp_matches({value}, '{V.INTEGER_PATTERN}')",
        "float": f"regexp_matches({value}, '(?i){V.FLOAT_PATTERN}')",
        "boolean": f"lower({value}) IN ({text_list(V.BOOLEAN_WORDS)})",
        "date": f"(try_strptime({value}, ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%d-%m-%Y', "
                f"'%m-%d-%Y', '%B %d, %Y', '%d %B %Y']) IS NOT NULL)",
        "datetime": f"(try_strptime({value}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', "
                    f"'%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%SZ', '%m/%d/%Y %H:%M:%S']) IS NOT NULL)",
        # the engine's own check also takes nan and inf in any spelling
        "json": f"(json_valid({value}) AND (NOT regexp_matches({value}, '(?i)^\\s*-?(nan|inf|infinity)\\s*$') "
                f"OR regexp_matches({value}, '^\\s*(NaN|-?Infinity)\\s*$')))",
    }[kind]


def sql_number(value: str) -> str:
    return f"CASE WHEN regexp_matches({value}, '(?i){V.NUMBER_PATTERN}') THEN TRY_CAST(trim({value}) AS DOUBLE) END"


def sql_level(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {floor} THEN '{name}'" for name, floor in V.LEVELS)
    return f"CASE {whens} ELSE '{V.LOWEST_LEVEL}' END"


DETECTED = [*V.PATTERNS, "integer", "float", "boolean", "date", "datetime", "json"]


def histogram_block(name: str, source: str, fields: list[str]) -> None:
    """``field_id, field, value, n`` over the text columns of ``source``."""
    parts = [f"SELECT {i} AS field_id, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM {source}"
             for i, f in enumerate(fields)]
    body = ("SELECT field_id, field, value, count(*) AS n FROM (" + " UNION ALL ".join(parts)
            + ") GROUP BY field_id, field, value")
    block(name, body, [source] if source in BLOCKS else [])


def profile_blocks(name: str, hist: str, order: list[str] | None = None) -> None:
    """``name``: the profile of a histogram block, one row per field."""
    order = order or V.TYPE_ORDER
    hits = ", ".join(f"sum(CASE WHEN {sql_matches(t, 'value')} THEN n ELSE 0 END) AS is_{t}" for t in DETECTED)
    block(f"{name}_sum", f"""
        SELECT field_id, any_value(field) AS field, sum(n) AS total, sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS nulls,
               sum(CASE WHEN value IS NULL THEN 0 ELSE n END) AS filled, count(value) AS uniq,
               min(length(value)) AS min_len, max(length(value)) AS max_len, sum(length(value) * n) AS sum_len,
               {hits}, sum(CASE WHEN {sql_matches('date', 'value')} OR {sql_matches('datetime', 'value')} THEN n ELSE 0 END) AS is_temporal
        FROM {hist} GROUP BY field_id""", [hist])
    block(f"{name}_num", f"""
        SELECT field_id, min(x) AS min_x, max(x) AS max_x, avg(x) AS mean_x, stddev_samp(x) AS std_x, count(x) AS numbers
        FROM (SELECT field_id, unnest(range(n)) AS copy_no, {sql_number('value')} AS x FROM {hist}) GROUP BY field_id""", [hist])
    ranked = " UNION ALL ".join(
        f"SELECT field_id, {i} AS rnk, '{t}' AS kind, "
        + (f"CASE WHEN uniq / filled < {V.CATEGORY_RATIO} AND uniq < {V.CATEGORY_DISTINCT} THEN filled ELSE 0 END" if t == "categorical" else f"is_{t}")
        + f" AS hits, filled FROM {name}_sum WHERE filled > 0"
        for i, t in enumerate(order))
    block(f"{name}_type", f"""
        SELECT field_id, CASE WHEN hits / filled >= {V.TYPE_ACCEPTANCE} AND hits > 0 THEN kind ELSE 'string' END AS detected_type
        FROM ({ranked}) QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY hits DESC, rnk) = 1""", [f"{name}_sum"])
    consistent = " ".join(f"WHEN detected_type = '{t}' THEN is_{t} / filled" for t in V.PATTERNS)
    block(name, f"""
        SELECT field_id, field, detected_type, total AS total_values, nulls AS null_count, uniq AS unique_values, nulls > 0 AS nullable,
               CASE WHEN detected_type IN ({text_list(V.LENGTH_TYPES)}) AND filled > 0 THEN min_len END AS min_length,
               CASE WHEN detected_type IN ({text_list(V.LENGTH_TYPES)}) AND filled > 0 THEN max_len END AS max_length,
               CASE WHEN detected_type IN ({text_list(V.LENGTH_TYPES)}) AND filled > 0 THEN sum_len / filled END AS avg_length,
               CASE WHEN detected_type IN ({text_list(V.NUMERIC_TYPES)}) THEN min_x END AS min_value,
               CASE WHEN detected_type IN ({text_list(V.NUMERIC_TYPES)}) THEN max_x END AS max_value,
               CASE WHEN detected_type IN ({text_list(V.NUMERIC_TYPES)}) THEN mean_x END AS mean_value,
               CASE WHEN detected_type IN ({text_list(V.NUMERIC_TYPES)}) THEN std_x END AS std_value,
               filled > 0 AND (uniq / total < {V.CATEGORY_RATIO} OR detected_type = 'categorical') AS is_categorical,
               CASE WHEN filled > 0 THEN filled / total ELSE 0.0 END AS completeness,
               CASE WHEN filled = 0 THEN 0.0 {consistent} ELSE 1.0 END AS consistency,
               CASE WHEN filled = 0 THEN 0.0 WHEN detected_type = 'integer' THEN is_integer / filled
                    WHEN detected_type = 'float' THEN numbers / filled WHEN detected_type = 'boolean' THEN is_boolean / filled
                    WHEN detected_type IN ('date', 'datetime') THEN is_temporal / filled ELSE 1.0 END AS validity
        FROM (SELECT s.*, coalesce(t.detected_type, 'string') AS detected_type, min_x, max_x, mean_x, std_x, numbers
              FROM {name}_sum s LEFT JOIN {name}_type t USING (field_id) JOIN {name}_num USING (field_id))""",
          [f"{name}_sum", f"{name}_type", f"{name}_num"])
