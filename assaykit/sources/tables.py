"""Stored tables whose partitions are replaced, merged and deleted in one step.

Spark writes rows into folders with fresh names; a small commit file then names the folder that is
live for each partition it changes, of one table or of several. Readers go by the commits. So what a
dead or repeated write left behind is never read, a partition that has become empty is empty, a
reader sees a load as a whole or not at all, and only the partitions concerned are written anew.

A table is partitioned by its key (a folder per job, say) or, where a key has few rows, by buckets of
it. The driver handles one line per partition; rows stay with the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "__part"
COMMIT = "version long, table string, part string, folder string, schema string"
#: commits between two files that hold all live partitions
SNAPSHOT = 20
#: parts of a bucket that a rewrite works on apart from each other
SPREAD = 16


class ConflictError(RuntimeError):
    """Another commit changed a partition that this one is based on."""


class Tables:
    """The tables under one folder, committed together."""

    def __init__(self, spark: SparkSession, root: str, key: str = "job_id", buckets: dict[str, int] | None = None) -> None:
        """``key`` names the column that all tables are partitioned by, ``buckets`` the tables that put many keys in one partition."""
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets or {}
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        plain = self._fs.Path(self.root)
        self._files = plain.getFileSystem(self._conf)
        self._log = self._files.makeQualified(self._fs.Path(plain, "log"))

    # ---- the log

    def _commits(self) -> list[tuple[int, str]]:
        """(version, kind) of all commit files."""
        if not self._files.exists(self._log):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._log)]
        return sorted((int(n.split(".")[0]), n.split(".")[1]) for n in names if n[:1].isdigit())

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max((v for v, _ in self._commits()), default=0)

    def _lines(self, after: int | None = None) -> DataFrame:
        """The lines of the commits: those after a version, or all that tell what is live now."""
        found = self._commits()
        start = max((v for v, kind in found if kind == "all"), default=0) if after is None else after
        names = [f"{v:012d}.{kind}.json" for v, kind in found if v > start and kind == "changes" or after is None and v == start and kind == "all"]
        paths = [f"{self._log}/{n}" for n in names]
        return self.spark.read.schema(COMMIT).json(paths) if paths else self.spark.createDataFrame([], COMMIT)

    def _live(self) -> DataFrame:
        """(table, part, version, folder, schema) as the last commits left them; the line of a table's schema has no part."""
        last = F.max_by(F.struct("version", "folder", "schema"), F.col("version")).alias("last")
        return self._lines().groupBy("table", "part").agg(last).select("table", "part", "last.*")

    def _write(self, name: str, lines: Iterable[dict]) -> bool:
        """Writes a commit file as a whole; False if there is one of this name."""
        hidden = self._fs.Path(self._log, f"_{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        for line in lines:
            out.write((json.dumps(line) + "\n").encode())
        out.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._fs.FileContext.getFileContext(self._log.toUri(), self._conf).rename(hidden, self._fs.Path(self._log, name), options)
        except Py4JJavaError as e:
            self._files.delete(hidden, False)
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def commit(self, changes: dict[tuple[str, str], str | None], schemas: dict[str, str], based_on: int | None = None) -> int:
        """Makes folders live: (table, part) -> folder, None for a partition that is empty now. Returns the version.

        Raises ConflictError if a commit after ``based_on`` changed one of these partitions.
        """
        while True:
            last = self.version()
            if based_on is not None and last > based_on:
                others = {(r["table"], r["part"]) for r in self._lines(based_on).filter("part is not null").select("table", "part").distinct().collect()}
                if clash := others & set(changes):
                    raise ConflictError(f"changed since version {based_on}: {sorted(clash)[:5]}")
                based_on = last
            lines = [{"version": last + 1, "table": t, "part": p, "folder": f} for (t, p), f in changes.items()]
            lines += [{"version": last + 1, "table": t, "schema": s} for t, s in schemas.items()]
            if self._write(f"{last + 1:012d}.changes.json", lines):
                if (last + 1) % SNAPSHOT == 0:
                    live = [r.asDict() for r in self._live().filter("folder is not null or schema is not null").collect()]
                    self._write(f"{last + 1:012d}.all.json", live)
                return last + 1

    # ---- rows

    def _name(self) -> Column:
        """A row's key as text that is never null."""
        return F.coalesce(F.concat(F.lit("="), F.col(f"`{self.key}`").cast("string")), F.lit("null"))

    def part(self, table: str) -> Column:
        """The partition that a row of the table belongs to."""
        n = self.buckets.get(table)
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast("string")), F.lit(n)).cast("string") if n else self._name()

    def stage(self, table: str, rows: DataFrame, dealt: bool = False) -> tuple[dict[str, str], str]:
        """Writes rows into a fresh folder that no commit names yet: (folder by partition, schema).

        The rows of a key lie side by side in a bucket. ``dealt`` says that few tasks hold rows of one
        partition already, so they need not move for that.
        """
        name = f"data/{table}-{uuid.uuid4().hex}"
        parted = rows.withColumn(PART, self.part(table))
        parted = parted if dealt else parted.hint("rebalance", PART)
        if self.buckets.get(table):
            parted = parted.sortWithinPartitions(PART, self._name())
        parted.write.partitionBy(PART).parquet(f"{self.root}/{name}")
        folder = self._fs.Path(f"{self.root}/{name}")
        names = [s.getPath().getName() for s in self._files.listStatus(folder) if s.isDirectory()]
        return {unquote(n.split("=", 1)[1]): f"{name}/{n}" for n in names}, rows.schema.json()

    def staged_rows(self, folders: dict[str, str], schema: str) -> DataFrame:
        """Reads what ``stage`` wrote."""
        return self._open(list(folders.values()), schema)

    def _open(self, folders: list[str], schema: str) -> DataFrame:
        types = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], types)
        return self.spark.read.schema(types).parquet(*[f"{self.root}/{f}" for f in folders])

    def _folders(self, table: str, parts: set[str] | None = None) -> tuple[dict[str, str], str]:
        """(live folder by partition, schema) of a table, or of some of its partitions."""
        lines = self._live().filter(F.col("table") == table)
        if parts is not None:
            lines = lines.filter(F.col("part").isNull() | F.col("part").isin(list(parts)))
        found = lines.collect()  # one line per partition
        schema = next((r["schema"] for r in found if r["schema"]), None)
        if schema is None:
            raise ValueError(f"no table {table} under {self.root}")
        return {r["part"]: r["folder"] for r in found if r["folder"]}, schema

    def _rows(self, table: str, parts: set[str] | None = None) -> DataFrame:
        return self.staged_rows(*self._folders(table, parts))

    def tables(self) -> list[str]:
        return sorted(r["table"] for r in self._live().filter("schema is not null").select("table").distinct().collect())

    def _keys(self, keys: DataFrame | list) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys.select(F.col(f"`{self.key}`").cast("string").alias(self.key)).distinct()
        return self.spark.createDataFrame([(None if k is None else str(k),) for k in keys], T.StructType([T.StructField(self.key, T.StringType())])).distinct()

    def _parts(self, table: str, keys: DataFrame) -> set[str]:
        return {r[0] for r in keys.select(self.part(table)).distinct().collect()}

    def _joined(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        mine = keys.select(F.col(f"`{self.key}`").alias("__key"))
        return rows.join(mine, F.col(f"`{self.key}`").cast("string").eqNullSafe(F.col("__key")), how)

    def _names(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of the rows as text; nothing else of the rows is read or moved."""
        return rows.select(self._name().alias("__name")).distinct()

    def _strange(self, rows: DataFrame, keys: DataFrame) -> list[str | None]:
        """A key of the rows that is not among the keys, if there is one."""
        found = self._names(rows).join(self._names(keys), "__name", "left_anti").limit(1).collect()
        return [None if r[0] == "null" else r[0][1:] for r in found]

    def _hit(self, table: str, rows: DataFrame, keys: DataFrame) -> set[str]:
        """The partitions in which rows of the keys are."""
        there = self._names(rows).join(self._names(keys), "__name", "left_semi")
        key = F.when(F.col("__name") != "null", F.substring("__name", 2, 2**31 - 1)).alias(self.key)
        return self._parts(table, there.select(key))

    def _without(self, table: str, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows of a bucketed table without those of the keys.

        Rows and keys are dealt together by parts of a bucket, where a key comes before its rows. So the
        rows move once, both to meet the keys and to be written.
        """
        marks = keys.select(self._name().alias("__name"), F.lit(True).alias("__gone"))
        both = rows.unionByName(marks, allowMissingColumns=True)
        name = F.coalesce("__name", self._name())
        plain = F.when(name != "null", F.substring(name, 2, 2**31 - 1))  # the key, of which part() takes the hash
        bucket, part = (F.pmod(F.xxhash64(plain), F.lit(n)) for n in (self.buckets[table], self.buckets[table] * SPREAD))
        upto = Window.partitionBy(bucket, name, part).orderBy(F.desc_nulls_last("__gone")).rowsBetween(Window.unboundedPreceding, 0)
        kept = both.repartition(part).withColumn("__gone", F.first("__gone").over(upto)).filter(F.col("__gone").isNull())
        return kept.drop("__name", "__gone")

    def read(self, table: str, keys: DataFrame | list | None = None) -> DataFrame:
        """The rows of a table, or of some keys: then only the folders of their partitions are listed and read."""
        if keys is None:
            return self._rows(table)
        keys = self._keys(keys)
        return self._joined(self._rows(table, self._parts(table, keys)), keys, "left_semi")

    def replace(self, frames: dict[str, DataFrame], keys: DataFrame | list) -> int:
        """All given tables get the frames' rows for ``keys`` in place of theirs, in one commit.

        A key without rows in a frame has none afterwards. Rows of other keys raise a ValueError
        before anything changes.
        """
        version, keys, changes, schemas = self.version(), self._keys(keys), {}, {}
        known = set(self.tables())
        for table, rows in frames.items():
            parts = self._parts(table, keys)
            if self.buckets.get(table):
                if strange := self._strange(rows, keys):
                    raise ValueError(f"rows of another {self.key} for {table}: {strange[0]}")
                if table in known:  # the other keys of these buckets move along
                    rows = rows.unionByName(self._joined(self._rows(table, parts), keys, "left_anti"), allowMissingColumns=True)
            folders, schemas[table] = self.stage(table, rows)
            if strange := sorted(set(folders) - parts):
                raise ValueError(f"rows of another {self.key} for {table}: {strange[:5]}")
            changes |= {(table, p): folders.get(p) for p in parts}
        return self.commit(changes, schemas, version)

    def merge(self, table: str, updates: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """``change(rows, updates)`` in place of the rows of the partitions that the updates' keys are in."""
        version = self.version()
        parts = self._parts(table, self._keys(updates))
        folders, schema = self.stage(table, change(self._rows(table, parts), updates))
        if strange := sorted(set(folders) - parts):
            raise ValueError(f"the change made rows in other partitions of {table}: {strange[:5]}")
        return self.commit({(table, p): folders.get(p) for p in parts}, {table: schema}, version)

    def delete(self, keys: DataFrame | list, tables: list[str] | None = None) -> int:
        """The keys go from all tables in one commit.

        Where a key has a partition of its own, nothing is read or written for it. Buckets in which no row
        goes keep their folders.
        """
        version, keys, changes = self.version(), self._keys(keys), {}
        for table in tables or self.tables():
            parts, folders = self._parts(table, keys), {}
            if self.buckets.get(table):
                folders, schema = self._folders(table, parts)
                if hit := self._hit(table, self.staged_rows(folders, schema), keys):
                    old = {p: f for p, f in folders.items() if p in hit}
                    folders = {p: f for p, f in folders.items() if p not in hit}
                    folders |= self.stage(table, self._without(table, self.staged_rows(old, schema), keys), dealt=True)[0]
            changes |= {(table, p): folders.get(p) for p in parts}
        return self.commit(changes, {}, version)

    def vacuum(self, hours: float = 168) -> int:
        """Removes folders that no commit makes live and that are older than ``hours``; returns their number.

        Choose more hours than a write or a read of an earlier version can take.
        """
        data = self._fs.Path(self.root, "data")
        if not self._files.exists(data):
            return 0
        live = {r["folder"].split("/")[1] for r in self._live().filter("folder is not null").select("folder").collect()}
        oldest = self.spark._jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000
        gone = [s.getPath() for s in self._files.listStatus(data) if s.getPath().getName() not in live and s.getModificationTime() <= oldest]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)
