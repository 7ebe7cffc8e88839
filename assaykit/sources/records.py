"""Text files to records, with one channel for what is malformed.

Every reader here gives the fields of a record and, beside them, ``_corrupt_record`` (the text),
``_corrupt_reason`` and ``_corrupt_file``, which are null for a sound record. Nothing is cut, filled up
or turned into null in silence.

Delimited files are looked at first, in one aggregate over their lines: the encoding of each file,
whether a quoted cell goes on over a line's end, and its header. Files that agree are read together;
only files with an open quote (and UTF-16, whose line ends are two bytes) are read in one piece each.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from .readers import CORRUPT, encoding_label, one_value, reader_nulls, sniff_separator

REASON, FILE = "_corrupt_reason", "_corrupt_file"
#: different layouts (encoding, quoting, header) under one path; more mean that the files have no headers
LAYOUTS = 1000


def channel(lines: DataFrame, reason: Column) -> DataFrame:
    """The reader's columns, the text of a malformed record, why it is malformed, and its file.

    The fields leave the scan as one struct, so all of them are parsed whatever a query reads: a
    record must not look sound because its broken field was pruned.
    """
    bad = F.col(CORRUPT).isNotNull()
    fields = [F.col(f"`{c}`") for c in lines.columns if c != CORRUPT]
    extra = [F.col(CORRUPT), F.when(bad, reason).alias(REASON), F.when(bad, F.col("_metadata.file_path")).alias(FILE)]
    return lines.select(F.inline(F.array(F.struct(*fields, *extra))))


def typed(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def strict(df: DataFrame) -> DataFrame:
    return df.drop(CORRUPT, REASON, FILE)


# ---- delimited text


def file_layouts(spark: SparkSession, path: str | list[str], encoding: str | None = None, headers: bool = True) -> DataFrame:
    """(file, encoding, whole, header) of every file with text; the header as its bytes in hexadecimal, ``encoding`` as given unless None.

    A line with an odd number of quotes opens or closes a cell that goes over the line's end.
    """
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    seen = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), *encoding_label(line)[0], (quotes % 2 == 1).alias("odd"),
        F.when(F.col("_metadata.file_block_start") == 0, F.struct(F.monotonically_increasing_id().alias("at"), line.alias("text"))).alias("head"))
    files = seen.groupBy("file").agg(*encoding_label(line)[1], F.bool_or("odd").alias("odd"), F.min("head").alias("head"))
    label = encoding_label(line)[2]
    names = F.create_map(*[F.lit(x) for pair in V.READER_ENCODINGS.items() for x in pair])
    found = F.lit(encoding) if encoding else names[label]
    named = files.select("file", found.alias("encoding"), "odd", F.when(F.lit(headers), F.hex(F.col("head.text").cast("binary"))).alias("header"))
    return named.select("file", "encoding", (F.col("odd") | F.upper("encoding").startswith("UTF-16")).alias("whole"), "header")


def header_columns(spark: SparkSession, file: str, encoding: str, sep: str) -> list[str]:
    """Column names in the first record of a file, read by the driver; named as Spark does where they are empty or repeated."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    size, start = 1 << 16, b""
    while True:
        stream = path.getFileSystem(conf).open(path)
        start = bytes((codec.createInputStream(stream) if codec else stream).readNBytes(size))
        stream.close()
        text = codecs.getincrementaldecoder(encoding)(errors="replace").decode(start).removeprefix("\ufeff")
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
        names = next((r for r in rows if r), [])
        if len(start) < size or rows.line_num < len(text.splitlines()):  # the record ends within what was read
            break
        size *= 8
    seen = Counter(n.strip().lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(n.strip() for n in names)]


def western_text(df: DataFrame) -> DataFrame:
    """Texts read as Latin-1 that are windows-1252: the two differ in 27 characters."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    ours, theirs = "".join(map(chr, codes)), bytes(codes).decode("cp1252")
    return df.select(*[F.translate(F.col(f"`{f.name}`"), ours, theirs).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name not in (REASON, FILE)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def cells(text: Column, sep: str) -> Column:
    """Number of cells of a line; quoted parts do not count."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def delimited_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, sep: str | None = None,
                      encoding: str | None = "UTF-8", malformed: str = "keep", usual: str = ",") -> DataFrame:
    """Delimited text with a header line in every file.

    Without a schema all columns are text, and a record has to have as many cells as the header of its
    own file; files with different headers are united by name. With a schema, cells have to fit it.
    ``sep`` None tries the ``usual`` one and counts the others where that gives a single column;
    ``encoding`` None looks at the bytes of each file. ``malformed`` is "keep" or "fail" (an error).
    A path without any text gives no rows, with the schema's columns or none.
    """
    if malformed not in ("keep", "fail"):
        raise ValueError("malformed is 'fail' or 'keep'")
    layouts = file_layouts(spark, path, encoding, headers=schema is None)
    groups = layouts.groupBy("encoding", "whole", "header").agg(F.min("file").alias("one")).limit(LAYOUTS + 1).collect()
    if len(groups) > LAYOUTS:
        raise ValueError(f"over {LAYOUTS} different headers: do these files have header lines?")
    if not groups:
        fields = typed(schema).fields if schema is not None else []
        return spark.createDataFrame([], T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in (CORRUPT, REASON, FILE)]]))
    parts = []
    for g in groups:
        same = F.col("encoding").eqNullSafe(g["encoding"]) & (F.col("whole") == g["whole"]) & F.col("header").eqNullSafe(g["header"])
        # a single group is the path itself; else its files are listed, as Spark lists them
        files = path if len(groups) == 1 else [plain_path(r["file"]) for r in layouts.filter(same).select("file").collect()]
        # the bytes of windows-1252 are read as Latin-1, of which Spark's reader knows, and its own characters put in afterwards
        western = g["encoding"].lower() in ("windows-1252", "cp1252")
        read_as = "ISO-8859-1" if western else g["encoding"]
        options = {"header": True, "encoding": read_as, "multiLine": g["whole"], "escape": '"'}
        by = sep or usual
        names = header_columns(spark, g["one"], g["encoding"], by)
        if sep is None and len(names) <= 1:
            by = sniff_separator(spark, files, read_as)
            names = header_columns(spark, g["one"], g["encoding"], by)
        full = typed(schema) if schema is not None else T.StructType([T.StructField(c, T.StringType()) for c in names])
        mode = "PERMISSIVE" if malformed == "keep" else "FAILFAST"
        lines = spark.read.options(**options, sep=by, mode=mode, columnNameOfCorruptRecord=CORRUPT).schema(with_corrupt(full)).csv(files)
        reason = F.when(cells(F.col(CORRUPT), by) != len(full), F.concat(cells(F.col(CORRUPT), by).cast("string"), F.lit(f" cells, not {len(full)}"))).otherwise("value does not fit")
        found = channel(lines, reason)
        parts.append(reader_nulls(western_text(found) if western else found))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kept = [c for c in united.columns if c not in (CORRUPT, REASON, FILE)]
    return united.select(*[F.col(f"`{c}`") for c in kept], CORRUPT, REASON, FILE)


def plain_path(file: str) -> str:
    """A file's own path, as one that a reader takes without reading patterns into it."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


# ---- JSON lines and XML


def json_line_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, malformed: str = "keep") -> DataFrame:
    """One JSON value per line. Without a schema the fields are those of all sound lines."""
    mode = "PERMISSIVE" if malformed == "keep" else "FAILFAST"
    if schema is None:
        found = spark.read.options(mode="PERMISSIVE" if malformed == "keep" else "FAILFAST", columnNameOfCorruptRecord=CORRUPT).json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != CORRUPT])
    lines = spark.read.options(mode=mode, columnNameOfCorruptRecord=CORRUPT).schema(with_corrupt(typed(schema))).json(path)
    return channel(lines, F.when(one_value(F.col(CORRUPT)), "value does not fit").otherwise("no JSON"))


def xml_records(spark: SparkSession, path: str | list[str], row_tag: str, schema: str | T.StructType | None = None, malformed: str = "keep") -> DataFrame:
    """The elements called ``row_tag``. Without a schema the types are those that all sound elements fit."""
    # the older parser gives the element's text for one that does not fit, the newer one that of the whole file
    reader = spark.read.format("xml").options(rowTag=row_tag, useLegacyXMLParser=True, mode="PERMISSIVE" if malformed == "keep" else "FAILFAST", columnNameOfCorruptRecord=CORRUPT)
    if schema is None:
        found = reader.load(path).schema
        schema = T.StructType([f for f in found.fields if f.name != CORRUPT])
    ends = F.rtrim(F.col(CORRUPT)).endswith(f"</{row_tag}>")
    return channel(reader.schema(with_corrupt(typed(schema))).load(path), F.when(ends, "value does not fit").otherwise("no XML"))
