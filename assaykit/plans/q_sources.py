"""Queries: readers, payloads, messages, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..operators import clean as C
from ..operators import warehouse as W
from ..session import table_path, work_path
from ..sources import messages as M
from ..sources import payloads as L
from ..sources import readers as D
from ..sources import records as N
from ..sources import sinks as Z
from ..sources.tables import Tables
from . import fixtures as X
from .catalog import query
from .ctes import block, text_list, with_blocks
from .q_profile import rounded
from .q_validate import res

_TOKENS = text_list(V.READER_NULL_TOKENS)
block("csv_back", "SELECT CAST(cust_key AS VARCHAR) AS cust_key, " + ", ".join(
    f"CASE WHEN {f} IN ({_TOKENS}) THEN NULL ELSE {f} END AS {f}" for f in X.DIRTY_FIELDS) + " FROM dirty", ["dirty"])


def _csv(spark, sf_dir, label, sep=","):
    path = work_path(spark, label) + ".csv"
    X.dirty(spark, sf_dir).write.options(**Z.KEEP_SPACES, sep=sep).csv(path)
    return path


@query(with_blocks(["csv_back"], "SELECT * FROM csv_back"))
def scan_csv_null_tokens(spark, sf_dir):
    return D.read_csv(spark, _csv(spark, sf_dir, "tokens"))


@query(with_blocks(["csv_back"], "SELECT ';' AS sep, * FROM csv_back UNION ALL SELECT '|', * FROM csv_back UNION ALL SELECT 'tab', * FROM csv_back"))
def scan_csv_sniff_sep(spark, sf_dir):
    out = None
    for name, sep in ((";", ";"), ("|", "|"), ("tab", "\t")):
        part = D.read_csv_sniffed(spark, _csv(spark, sf_dir, "sniff", sep)).select(F.lit(name).alias("sep"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_LATIN = r"[^\x20-\x7e\xa0-\xff]"


@query(rf"""SELECT name AS folder, encoding, issue AS encoding_issue, (SELECT count(*) FROM documents) AS records,
            (SELECT CAST(sum(length(regexp_replace(coalesce(text, ''), '[^\x20-\x7e\x{{a0}}-\x{{ff}}]', ' ', 'g'))) AS BIGINT) FROM documents) AS characters
            FROM (VALUES ('latin', 'latin-1', true), ('plain', 'utf-8', false), ('wide', 'utf-16', false)) t(name, encoding, issue)""")
def encoding_audit(spark, sf_dir):
    """All documents written in three encodings and read back by the label that their bytes get."""
    root, out = work_path(spark, "encodings"), None
    plain = {"sep": "\t", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # one source row per line; C1 bytes do not occur in the text
    text = X.read_table(spark, sf_dir, "documents").select(F.concat(F.lit("|"), F.regexp_replace(F.coalesce("text", F.lit("")), _LATIN, " ")).alias("t"))
    for folder, encoding in (("plain", "UTF-8"), ("latin", "ISO-8859-1"), ("wide", "UTF-16")):
        text.write.options(encoding=encoding, **plain).csv(f"{root}/{folder}")
        found = D.encoding_of(spark, f"{root}/{folder}")
        back = spark.read.options(encoding=found, multiLine=found == "UTF-16", **plain).schema("t string").csv(f"{root}/{folder}")
        label = {v: k for k, v in V.READER_ENCODINGS.items()}[found]
        part = back.agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("t") - 1).alias("characters")).select(
            F.lit(folder).alias("folder"), F.lit(label).alias("encoding"), F.lit(label not in ("utf-8", "utf-16")).alias("encoding_issue"), "records", "characters")
        out = part if out is None else out.unionByName(part)
    return out


_LINE = T.StructType([T.StructField("id", T.LongType()), T.StructField("city", T.StringType()), T.StructField("amount", T.DoubleType())])


def _marked(spark, sf_dir):
    """Order lines as CSV text; an unquoted extra comma every fiftieth, a word for a number every seventieth."""
    path = work_path(spark, "marked")
    k = F.col("o_orderkey")
    city = F.when(k % 50 == 0, F.lit("Rua do Paco, 67")).otherwise(F.lit("Oslo"))
    amount = F.when(k % 70 == 0, F.lit("many")).otherwise((k % 100).cast("string"))
    X.read_table(spark, sf_dir, "orders").select(F.concat_ws(",", k.cast("string"), city, amount)).write.text(path)
    return D.read_csv_marked(spark, path, _LINE, header=False)


@query("""SELECT o_orderkey % 50 = 0 OR o_orderkey % 70 = 0 AS corrupt, count(*) AS record_count,
          CAST(sum(CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 70 <> 0 THEN o_orderkey % 100 END) AS DOUBLE) AS amount FROM orders GROUP BY 1""")
def scan_csv_corrupt(spark, sf_dir):
    rows = _marked(spark, sf_dir)
    sound = F.col(D.CORRUPT).isNull()
    return rows.groupBy((~sound).alias("corrupt")).agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(F.when(sound, F.col("amount"))).alias("amount"))


@query("""SELECT o_orderkey AS id, o_orderkey || ',' || CASE WHEN o_orderkey % 50 = 0 THEN 'Rua do Paco, 67' ELSE 'Oslo' END || ',' ||
          CASE WHEN o_orderkey % 70 = 0 THEN 'many' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS original_data,
          'Validation error: malformed record' AS issue, CAST(0.0 AS DOUBLE) AS quality_score, CAST(1.0 AS DOUBLE) AS severity_score, 'Validation exception' AS quarantine_reason
          FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 70 = 0""")
def validate_corrupt_rows(spark, sf_dir):
    """Unreadable records go to quarantine with score 0 and full severity."""
    bad = _marked(spark, sf_dir).filter(F.col(D.CORRUPT).isNotNull())
    return bad.select(
        "id", F.col(D.CORRUPT).alias("original_data"),
        F.lit("Validation error: malformed record").alias("issue"), F.lit(0.0).alias("quality_score"), F.lit(1.0).alias("severity_score"),
        F.lit("Validation exception").alias("quarantine_reason"))


def _faulty(spark, sf_dir):
    """Order lines in four formats, (format, folder): a broken record every fiftieth, a word for a number every seventieth."""
    root, k = work_path(spark, "faulty"), F.col("o_orderkey")
    broken, amount = k % 50 == 0, F.when(k % 70 == 0, F.lit("many")).otherwise((k % 100).cast("string"))
    orders = X.read_table(spark, sf_dir, "orders")
    for ext, sep in (("csv", ","), ("tsv", "\t")):
        line = F.concat_ws(sep, k.cast("string"), F.when(broken, F.lit(f"Rua do Paco{sep} 67")).otherwise(F.lit("Oslo")), amount)
        orders.select(line.alias(sep.join(("id", "city", "amount")))).write.options(
            header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}/in.{ext}")
    value = F.when(k % 70 == 0, F.lit('"many"')).otherwise((k % 100).cast("string"))
    orders.select(F.concat(F.lit('{"id":'), k.cast("string"), F.when(broken, F.lit(',"city"')).otherwise(F.lit(',"city":"Oslo"')),
                           F.lit(',"amount":'), value, F.lit("}"))).write.text(f"{root}/in.jsonl")
    element = F.concat(F.lit("<row><id>"), k.cast("string"), F.lit("</id><city>Oslo</city><amount>"),
                       F.when(broken, F.lit("none")).otherwise(amount), F.lit("</amount></row>"))
    orders.select(element).write.text(f"{root}/in.xml")
    return [(ext, f"{root}/in.{ext}") for ext in ("csv", "tsv", "jsonl", "xml")]


@query("""
    WITH k AS (SELECT o_orderkey AS k, o_orderkey % 50 = 0 AS broken, o_orderkey % 70 = 0 AS word FROM orders),
    f(format, typed, syntax) AS (VALUES ('csv', true, '4 cells, not 3'), ('tsv', true, '4 cells, not 3'), ('jsonl', true, 'no JSON'), ('xml', true, 'value does not fit'),
                                ('csv', false, '4 cells, not 3'), ('tsv', false, '4 cells, not 3'), ('jsonl', false, 'no JSON'), ('xml', false, NULL))
    SELECT format, typed, CASE WHEN broken THEN syntax WHEN word AND typed THEN 'value does not fit' END AS reason, count(*) AS records,
           CAST(sum(k) AS BIGINT) AS ids, CAST(sum(k) FILTER (WHERE NOT broken AND NOT word) AS BIGINT) AS plain
    FROM (SELECT *, CASE WHEN broken THEN syntax WHEN word AND typed THEN 'x' END IS NULL AS sound FROM k, f) GROUP BY ALL""")
def scan_malformed(spark, sf_dir):
    """Every text format with planted faults, with a schema and without: a record is either read or kept with its text and the reason."""
    out, plain = None, (F.col("id") % 50 != 0) & (F.col("id") % 70 != 0)
    for ext, path in _faulty(spark, sf_dir):
        for schema in ("id long, city string, amount long", None):
            rows = D.load(spark, path, schema=schema, malformed="keep")
            first = F.regexp_extract(D.CORRUPT, "[0-9]+", 0).cast("long")  # the id is the first number of a record
            part = rows.select(F.col(N.REASON).alias("reason"), F.when(F.col(D.CORRUPT).isNull(), F.col("id").cast("long")).otherwise(first).alias("id")).groupBy("reason").agg(
                F.count(F.lit(1)).alias("records"), F.sum("id").alias("ids"), F.sum(F.when(plain, F.col("id"))).alias("plain")).select(
                F.lit(ext).alias("format"), F.lit(schema is not None).alias("typed"), "reason", "records", "ids", "plain")
            out = part if out is None else out.unionByName(part)
    return out


_DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars FROM documents")
def csv_quoted_text(spark, sf_dir):
    """All documents through CSV and back: their texts hold quotes, commas and line breaks."""
    path = work_path(spark, "texts") + ".csv"
    Z.save(X.read_table(spark, sf_dir, "documents"), path, "csv")
    return D.load(spark, path, schema=_DOCUMENT).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", "source", "n_chars")


_FILE_ENCODINGS = ("UTF-8", "UTF-16", "windows-1252", "ISO-8859-1")


@query(r"""SELECT doc_id, sha256(CASE WHEN doc_id % 4 < 2 THEN 'é漢字ελ' || coalesce(text, '')
            ELSE 'é' || CASE WHEN doc_id % 4 = 2 THEN '€' ELSE '' END || regexp_replace(coalesce(text, ''), '[^\x0a\x20-\x7e\x{a0}-\x{ff}]', ' ', 'g') END) AS text_sha256 FROM documents""")
def scan_mixed_encodings(spark, sf_dir):
    """One folder with files in four encodings, every document in one of them, all scripts where the encoding has them."""
    root, kind = work_path(spark, "mixed"), F.col("doc_id") % 4
    text = F.coalesce("text", F.lit(""))
    docs = X.read_table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.when(kind < 2, F.lit("é漢字ελ")).otherwise(F.lit("é")), F.when(kind == 2, F.lit("€")).otherwise(F.lit("")),
        F.when(kind < 2, text).otherwise(F.regexp_replace(text, r"[^\x0a\x20-\x7e\xa0-\xff]", " "))).alias("text"))
    for i, encoding in enumerate(_FILE_ENCODINGS):
        part = docs.filter(kind == i)
        if encoding == "windows-1252":  # the euro sign is its byte 0x80, as one of Latin-1's control characters is
            part, encoding = part.withColumn("text", F.translate("text", "€", "\x80")), "ISO-8859-1"
        part.write.options(**Z.KEEP_SPACES, encoding=encoding, quoteAll=True).csv(f"{root}/{i}")
    back = D.load(spark, f"{root}/*", "csv", schema="doc_id long, text string", encoding=None)
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


_NESTED = "id long, place struct<city:string,zip:long>"


@query("SELECT o_orderkey AS id, 'Oslo' AS \"place.city\", o_orderkey % 100 AS \"place.zip\" FROM orders")
def scan_json_multiline(spark, sf_dir):
    """Orders as JSON arrays, one document per file, nested objects flattened."""
    path = work_path(spark, "documents")
    k = F.col("o_orderkey")
    item = F.concat(F.lit(","), F.to_json(F.struct(k.alias("id"), F.struct(F.lit("Oslo").alias("city"), (k % 100).alias("zip")).alias("place"))))
    orders = X.read_table(spark, sf_dir, "orders")
    # 100,000 records per document: the number of documents grows with the table, their size does not
    doc = F.floor(k / 100000)
    lines = orders.select(doc.alias("doc"), F.lit(1).alias("part"), item.alias("line"))
    edges = orders.select(doc.alias("doc")).distinct().select("doc", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("[{}").alias("line")), F.struct(F.lit(2).alias("part"), F.lit("]").alias("line")))))
    whole = lines.unionByName(edges).repartition("doc").sortWithinPartitions("doc", "part")
    whole.select("doc", "line").write.partitionBy("doc").text(path)
    return C.drop_empty_rows(C.flatten(D.read_json(spark, path + "/*/*.txt", _NESTED)))


_PLAIN_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
_PLAIN = [field.split()[0] for field in _PLAIN_SCHEMA.split(", ")]
_PLAIN_SQL = f"SELECT {', '.join(_PLAIN)} FROM orders"


def _orders(spark, sf_dir):
    return X.read_table(spark, sf_dir, "orders").select(*_PLAIN)


@query(_PLAIN_SQL)
def scan_jsonl(spark, sf_dir):
    path = work_path(spark, "lines") + ".jsonl"
    _orders(spark, sf_dir).write.json(path)
    return D.read_json(spark, path, _PLAIN_SCHEMA, lines=True)


@query(_PLAIN_SQL)
def scan_json_lines_as_json(spark, sf_dir):
    """JSON lines under the extension of documents, as the library's own sink writes them: no record is lost."""
    path = work_path(spark, "lines") + ".json"
    Z.save(X.read_table(spark, sf_dir, "orders").select(*_PLAIN), path, "json")
    return D.load(spark, path, schema=_PLAIN_SCHEMA)


@query(_PLAIN_SQL)
def scan_parquet(spark, sf_dir):
    return D.read_parquet(spark, table_path(sf_dir, "orders")).select(*_PLAIN)


@query(_PLAIN_SQL)
def scan_tsv(spark, sf_dir):
    path = work_path(spark, "tabs") + ".tsv"
    _orders(spark, sf_dir).write.options(header=True, sep="\t").csv(path)
    return D.read_delimited(spark, path, _PLAIN_SCHEMA)


@query(_PLAIN_SQL)
def scan_xml(spark, sf_dir):
    path = work_path(spark, "tags") + ".xml"
    _orders(spark, sf_dir).write.format("xml").option("rowTag", "order").save(path)
    return D.read_xml(spark, path, "order", _PLAIN_SCHEMA)


_AUTO = ("csv", "tsv", "jsonl", "parquet", "xml")


@query(" UNION ALL ".join(f"SELECT '{f}' AS extension, {', '.join(_PLAIN)} FROM orders WHERE o_orderkey % 5 = {i}" for i, f in enumerate(_AUTO)))
def scan_auto(spark, sf_dir):
    """Five formats read back by their extension."""
    root, df, out = work_path(spark, "auto"), _orders(spark, sf_dir), None
    for i, ext in enumerate(_AUTO):
        part, path = df.filter(F.col("o_orderkey") % 5 == i), f"{root}/orders.{ext}"
        if ext in ("csv", "tsv"):
            part.write.options(header=True, sep="," if ext == "csv" else "\t").csv(path)
        elif ext == "jsonl":
            part.write.json(path)
        elif ext == "xml":
            part.write.format("xml").option("rowTag", "row").save(path)
        else:
            part.write.parquet(path)
        back = D.load(spark, path, schema=_PLAIN_SCHEMA).select(F.lit(ext).alias("extension"), *_PLAIN)
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT *, 'status_' || o_orderstatus || '.csv' AS _source_file FROM (" + _PLAIN_SQL + ")")
def scan_multi_file_tagged(spark, sf_dir):
    root, df = work_path(spark, "many"), _orders(spark, sf_dir)
    paths = []
    for status in ("F", "O", "P"):
        paths.append(f"{root}/status_{status}.csv")
        df.filter(F.col("o_orderstatus") == status).write.options(header=True).csv(paths[-1])
    return D.load_many(spark, paths, schema=_PLAIN_SCHEMA)


# ---- payloads ----------------------------------------------------------------------------------
_PAYLOAD = """CASE k % 7 WHEN 0 THEN concat('[{"id": ', k, ', "v": 1}, {"id": ', k, ', "v": 2}]')
    WHEN 1 THEN concat('{"page": 1, "records": [{"id": ', k, ', "v": 3}]}') WHEN 2 THEN concat('{"tags": ["x"], "data": [{"id": ', k, ', "v": 4}, {"id": ', k, ', "v": 5}]}')
    WHEN 3 THEN concat('{"total": 1, "zz": [{"id": ', k, ', "v": 6}], "aa": [{"id": 0, "v": 0}]}') WHEN 4 THEN concat('{"id": ', k, ', "v": 7}')
    WHEN 5 THEN '{broken' ELSE concat('{"results": [{"id": ', k, ', "v": 8}]}') END"""


@query("""SELECT o_orderkey AS payload_id, o_orderkey AS id, CAST(v AS BIGINT) AS v FROM orders JOIN
          (VALUES (0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (3, 6), (4, 7), (6, 8)) t(r, v) ON o_orderkey % 7 = r""")
def payload_to_records(spark, sf_dir):
    payloads = X.read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k AS payload_id", f"{_PAYLOAD} AS payload")
    rows = L.json_records(payloads, "payload", ["payload_id"])
    return rows.select("payload_id", F.try_variant_get("record", "$.id", "bigint").alias("id"), F.try_variant_get("record", "$.v", "bigint").alias("v"))


@query("""SELECT o_orderkey AS payload_id, CAST(i AS INTEGER) AS record_index, o_orderkey + i AS id,
          CASE WHEN i = 0 THEN 'plain' WHEN o_orderkey % 2 = 0 THEN 'with, comma' ELSE 'two' || chr(10) || 'lines "quoted"' END AS label
          FROM orders, (VALUES (0), (1)) t(i)""")
def payload_csv_to_records(spark, sf_dir):
    """Every other payload has its columns in another order and a line break in a quoted cell."""
    payloads = X.read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS payload_id", r'''CASE WHEN o_orderkey % 2 = 0
        THEN concat('id,label\r\n', o_orderkey, ',plain\r\n', o_orderkey + 1, ',"with, comma"\r\n')
        ELSE concat('label,id\r\nplain,', o_orderkey, '\r\n"two\nlines ""quoted""",', o_orderkey + 1, '\r\n') END AS payload''')
    return L.csv_records(payloads, "payload", "id long, label string", ["payload_id"])


# ---- messages -----------------------------------------------------------------------------------
@query("""SELECT CAST(event_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id ||
          ',"event_type":"' || event_type || '","value":' || coalesce(CAST(value AS VARCHAR), 'null') || ',"props":' || coalesce(CAST(to_json(props) AS VARCHAR), 'null') || '}' AS value FROM events""")
def kafka_encode(spark, sf_dir):
    return M.encode(X.read_table(spark, sf_dir, "events"), "event_id")


def _messages(spark, sf_dir):
    """Event properties as messages; every ninth is cut off and every thirteenth is no object."""
    k = F.col("event_id")
    value = F.when(k % 9 == 0, F.expr("left(props, length(props) - 1)")).when(k % 13 == 0, F.lit("plain text")).otherwise(F.col("props"))
    return X.read_table(spark, sf_dir, "events").select(k.cast("string").alias("key"), value.alias("value"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS messages FROM events WHERE event_id % 9 <> 0 AND event_id % 13 <> 0 GROUP BY 1")
def kafka_decode(spark, sf_dir):
    return M.decode(_messages(spark, sf_dir), "k long").groupBy("k").agg(F.count(F.lit(1)).alias("messages"))


@query("SELECT count(*) AS total_records, count(*) FILTER (WHERE o_orderkey % 11 <> 0) AS sent_records, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS error_records, round(count(*) FILTER (WHERE o_orderkey % 11 <> 0) / count(*) * 100, 6) AS success_rate_pct FROM orders")
def send_stats(spark, sf_dir):
    """Counts observed while the messages are written."""
    orders = X.read_table(spark, sf_dir, "orders")
    messages = M.encode(orders, "o_orderkey", _PLAIN).withColumn("value", F.when(F.col("key").cast("long") % 11 != 0, F.col("value")))
    watched, seen = M.send_stats(messages)
    watched.write.parquet(work_path(spark, "topic"))
    n = seen.get
    rate = round(n["sent_records"] / n["total_records"] * 100, 6) if n["total_records"] else 0.0
    return spark.range(1).select(*[F.lit(n[c]).cast("long").alias(c) for c in ("total_records", "sent_records", "error_records")], F.lit(rate).alias("success_rate_pct"))


# ---- sinks -----------------------------------------------------------------------------------------
@query(" UNION ALL ".join(f"SELECT '{f}' AS format, {', '.join(_PLAIN)} FROM orders" for f in ("csv", "json", "parquet")))
def sink_roundtrip(spark, sf_dir):
    root, df, out = work_path(spark, "sinks"), _orders(spark, sf_dir), None
    for fmt in ("csv", "json", "parquet"):
        Z.save(df, f"{root}/{fmt}", fmt)
        back = D.load(spark, f"{root}/{fmt}", "jsonl" if fmt == "json" else fmt, _PLAIN_SCHEMA).select(F.lit(fmt).alias("format"), *_PLAIN)
        out = back if out is None else out.unionByName(back)
    return out


@query(with_blocks(["res"], """
    SELECT CASE WHEN NOT is_valid THEN 'bad' WHEN quality_score >= 0.99 THEN 'high_quality' ELSE 'good' END AS disposition, count(*) AS record_count,
           CAST(sum(issue_count) AS BIGINT) AS issue_count FROM res GROUP BY 1"""))
def sink_split_outputs(spark, sf_dir):
    path = work_path(spark, "split")
    Z.save_split(res(spark, sf_dir), path, 0.99)
    back = spark.read.parquet(path)
    return back.groupBy("disposition").agg(F.count(F.lit(1)).alias("record_count"), F.sum(F.size("issues")).alias("issue_count"))


@query(with_blocks(["res"], "SELECT 'job-1' AS job_id, cust_key AS record_id, is_valid, round(quality_score, 6) AS quality_score, quality_level FROM res"))
def load_validation_fact(spark, sf_dir):
    tables = Tables(spark, work_path(spark, "fact"))
    fact = W.validation_fact(res(spark, sf_dir), F.lit("job-1"), F.col("cust_key"))
    for _ in range(2):  # a repeated load replaces the job's partition
        tables.replace({"validation": fact}, ["job-1"])
    return rounded(tables.read("validation").select("job_id", "record_id", "is_valid", "quality_score", "quality_level"), "quality_score")
