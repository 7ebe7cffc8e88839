"""Readers for files. All of them return DataFrames and none brings data to the driver."""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V

CORRUPT = "_corrupt_record"


def reader_nulls(df: DataFrame) -> DataFrame:
    """Null words of a reader, compared with the whole cell."""
    return df.select(*[
        F.when(~F.col(f"`{f.name}`").isin(V.READER_NULL_TOKENS), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name != CORRUPT else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, sep: str = ",",
             encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Delimited text with a header. Without a schema every column is text: no pass over the data to guess types."""
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=multi_line, escape='"', mode="PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader_nulls(reader.csv(path))


def separator_counts(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Fewest and most fields per line under each candidate separator, in one pass; quoted parts do not count."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    lines = spark.read.options(sep="\x01", quote="", encoding=encoding, multiLine=encoding.upper().startswith("UTF-16")).schema("value string").csv(path)
    sizes = lines.filter(F.trim("value") != "").select(*[
        (F.length(bare) - F.length(F.replace(bare, F.lit(s))) + 1).alias(f"n{i}") for i, s in enumerate(V.SEPARATORS)])
    wide = sizes.agg(*[f(f"n{i}").alias(f"{n}{i}") for i in range(len(V.SEPARATORS)) for n, f in (("min", F.min), ("max", F.max))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(s).alias("separator"), F.col(f"min{i}").alias("fewest"), F.col(f"max{i}").alias("most"))
        for i, s in enumerate(V.SEPARATORS)])))


def sniff_separator(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> str:
    """The separator that splits every line alike into the most fields; else the one with the largest minimum."""
    rows = separator_counts(spark, path, encoding).collect()  # one row per candidate
    steady = [r for r in rows if r["fewest"] == r["most"] and (r["fewest"] or 0) > 1]
    best = max(steady or rows, key=lambda r: (r["fewest"] or 0, -r["rank"]))
    return best["separator"]


def read_csv_sniffed(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sniff_separator(spark, path))


def read_csv_marked(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", header: bool = True,
                    encoding: str = "UTF-8", mode: str = "PERMISSIVE", multi_line: bool = False) -> DataFrame:
    """CSV that keeps malformed lines: their text is in ``_corrupt_record``.

    The fields leave the scan as one struct, so all of them are parsed whatever a query reads: a
    line must not look sound because its broken field was pruned.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.options(header=header, sep=sep, encoding=encoding, multiLine=multi_line, mode=mode, columnNameOfCorruptRecord=CORRUPT, escape='"')
    lines = reader.schema(full).csv(path)
    return reader_nulls(lines.select(F.inline(F.array(F.struct(*lines.columns)))))


def encoding_audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Encoding label per file, from the bytes of all lines.

    The text source hands over the bytes of a line as they are, so a large file is read in splits
    and combined per file, where a whole-file scan would need each file in one task's memory.
    """
    flags, seen, label = encoding_label(F.col("value"))
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), *flags).groupBy("file").agg(*seen)
    return files.select("file", label.alias("encoding"), (~F.col("utf8") & ~F.col("bom16")).alias("encoding_issue"))


def encoding_label(line: Column) -> tuple[list[Column], list[Column], Column]:
    """What a line's bytes tell, how that is combined per file, and the label that follows."""
    raw = F.hex(line.cast("binary"))
    flags = [F.is_valid_utf8(line).alias("utf8"), raw.rlike("^(FFFE|FEFF)").alias("bom16"), raw.rlike("^([0-9A-F]{2})*[89][0-9A-F]").alias("c1")]
    seen = [F.bool_and("utf8").alias("utf8"), F.bool_or("bom16").alias("bom16"), F.bool_or("c1").alias("c1")]
    return flags, seen, F.when(F.col("bom16"), "utf-16").when(F.col("utf8"), "utf-8").when(F.col("c1"), "cp1252").otherwise("latin-1")


def read_json(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, lines: bool = False) -> DataFrame:
    """One JSON document per file (array or object), or one object per line. Only the latter can be split."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*([path] if isinstance(path, str) else path))


def read_delimited(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, sep: str = "\t") -> DataFrame:
    return read_csv(spark, path, schema, sep)


def read_xml(spark: SparkSession, path: str | list[str], row_tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def format_of(path: str) -> str:
    """Reader for a path by its extension; an unknown one fails before any job starts."""
    extension = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if extension not in V.READER_FORMATS:
        raise ValueError(f"unsupported file format: .{extension}; one of {sorted(V.READER_FORMATS)}")
    return V.READER_FORMATS[extension]


def encoding_of(spark: SparkSession, path: str) -> str:
    """Encoding of all files under a path, as a name that readers take; an ASCII-only part does not hide what the others are."""
    labels = {r["encoding"] for r in encoding_audit(spark, path).select("encoding").distinct().collect()}  # four labels at most
    return next((V.READER_ENCODINGS[x] for x in V.READER_ENCODINGS if x in labels), "UTF-8")


def one_value(text: Column) -> Column:
    """Whether a text is exactly one JSON value, with nothing before or after it.

    What follows a value can go on as an array or as an object, but not as both.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    in_object = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1
    return F.coalesce(in_array & in_object, F.lit(False))


def json_layouts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, lines): whether a JSON file holds one value per line, from all its lines; files without text are left out."""
    record = F.col("value").rlike(r"^\s*[{\[]") & one_value(F.col("value"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").rlike(r"\S"))
    return lines.groupBy("file").agg(F.bool_and(record).alias("lines"))


def read_json_either(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents or JSON lines under one extension, decided for each file by all of its lines.

    A file that is neither one value per line nor one document raises an error that names it, as do
    records that do not fit the schema: none is lost. Texts in UTF-16 or UTF-32 are read as documents.
    """
    files: dict[bool, list[str]] = {True: [], False: []}
    for r in json_layouts(spark, path).collect():  # one row per file, as in the driver's own list of files
        files[r["lines"]].append(re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(r["file"])))
    if files[False]:
        text = F.regexp_replace("value", "^\ufeff", "")
        broken = spark.read.text(files[False], wholetext=True).filter(~F.contains("value", F.lit("\0")) & ~one_value(text))
        bad = [r["file"] for r in broken.select(F.col("_metadata.file_path").alias("file")).limit(5).collect()]
        if bad:
            raise ValueError(f"malformed: neither JSON lines nor one JSON document: {', '.join(bad)}")
    parts = []
    for lines, names in files.items():
        if names or lines and not files[False]:
            reader = spark.read.options(mode="FAILFAST", multiLine=not lines)
            one_file = len(names) == 1 and isinstance(path, str) and names[0].endswith(path)
            if files[False] and isinstance(path, str) and not one_file and not re.search(r"[\\{}\[\]*?]", path):
                reader = reader.option("basePath", path)  # columns in folder names
            parts.append((reader.schema(schema) if schema is not None else reader).json(names if files[False] else path))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_any(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, sep: str | None = None,
                 encoding: str | None = "UTF-8", malformed: str = "fail") -> DataFrame:
    """CSV whose separator and encoding may be unknown.

    Without ``sep`` the comma is tried; only if it gives a single column the lines are counted for the
    other separators. ``encoding`` None looks at the bytes. With a schema, lines that do not fit it
    raise an error (``malformed="fail"``) or are kept with their text (``"keep"``, in
    ``_corrupt_record``): none is cut in silence. Without a schema all columns are text.
    """
    encoding = encoding or encoding_of(spark, path)
    whole = encoding.upper().startswith("UTF-16")  # its line ends are two bytes: such a file is read in one piece
    if sep is None:
        sep = ","
        if len(spark.read.options(header=True, encoding=encoding, multiLine=whole).csv(path).columns) <= 1:
            sep = sniff_separator(spark, path, encoding)
    if schema is None:
        return read_csv(spark, path, None, sep, encoding, whole)
    full = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if malformed == "keep":
        return read_csv_marked(spark, path, full, sep, encoding=encoding, multi_line=whole)
    if malformed != "fail":
        raise ValueError("malformed is 'fail' or 'keep'")
    return read_csv_marked(spark, path, full, sep, encoding=encoding, mode="FAILFAST", multi_line=whole).drop(CORRUPT)


def load(spark: SparkSession, path: str, fmt: str | None = None, schema: str | T.StructType | None = None, row_tag: str = "row",
         sep: str | None = None, encoding: str | None = "UTF-8", malformed: str = "fail") -> DataFrame:
    """Read a path by its extension or by the named format.

    ``malformed`` says what becomes of records that cannot be read or do not fit: "fail" raises an
    error, "keep" keeps them with their text, the reason and the file in ``_corrupt_record``,
    ``_corrupt_reason`` and ``_corrupt_file`` (delimited text, JSON lines, XML; a broken JSON document
    always raises). ``sep`` and ``encoding`` are those of delimited text; None looks at the files.
    """
    from . import records as R

    def done(df: DataFrame) -> DataFrame:
        return df if malformed == "keep" else R.strict(df)

    if malformed not in ("fail", "keep"):
        raise ValueError("malformed is 'fail' or 'keep'")
    readers = {
        "csv": lambda: done(R.delimited_records(spark, path, schema, sep, encoding, malformed)),
        "json": lambda: read_json_either(spark, path, schema),
        "jsonl": lambda: done(R.json_line_records(spark, path, schema, malformed)),
        "parquet": lambda: read_parquet(spark, path, schema),
        "delimited": lambda: done(R.delimited_records(spark, path, schema, sep, encoding, malformed, usual="\t")),
        "xml": lambda: done(R.xml_records(spark, path, row_tag, schema, malformed)),
    }
    kind = fmt or format_of(path)
    if kind not in readers:
        raise ValueError(f"unsupported format: {kind}; one of {sorted(readers)}")
    return readers[kind]()


def tag_source(df: DataFrame, name: Column | None = None) -> DataFrame:
    """Adds ``_source_file``: the file each record came from."""
    return df.withColumn("_source_file", F.col("_metadata.file_name") if name is None else name)


def load_many(spark: SparkSession, paths: list[str], fmt: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Several inputs as one frame, each record tagged with the input it came from."""
    parts = [tag_source(load(spark, p, fmt, schema), F.lit(os.path.basename(p.rstrip("/")))) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
