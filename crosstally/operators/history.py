"""Versioned tables in files by ranges of keys: a merge writes only the files whose keys meet a change.

Files are sorted by entity; the commit log keeps each file's first and last key. A merge looks up which files can hold the changed
entities, works out their history anew, and commits new files in place of these; all others keep their paths. Two merges at
once can't lose a change: the later one finds its files replaced and begins again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog, Folder
from .versioned import _ids, upsert

#: Rows of a file at most, unless an entity has more.
FILE_ROWS = 500_000
#: Merges that may be ahead of one before it gives up.
ATTEMPTS = 20


class HistoryTable:
    def __init__(self, spark: SparkSession, path: str, ids: str | Sequence[str], schema: T.StructType | str, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.file_rows = spark, path.rstrip("/"), file_rows
        self.ids = _ids(ids)
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, self.path)

    @property
    def _key_type(self) -> T.StructType:
        return T.StructType([self.schema[c] for c in self.ids])

    def files(self) -> list[Folder]:
        """Files in order of their keys. Files that take the place of one have its place, or follow one another below it."""
        return sorted(self.log.folders("file"), key=lambda f: f.facts["place"])

    def _read(self, files: Sequence[Folder]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f.path}" for f in files])

    def read(self) -> DataFrame:
        return self._read(self.files())

    def _write(self, rows: DataFrame, places: dict[int, list[int]], number: Column) -> list[Folder]:
        """New files of these rows, none across two ``number``s, which tell their places; not seen before they are committed."""
        folder = f"files/{uuid.uuid4().hex}"
        ordered = rows.select(*self.schema.names, number.cast("int").alias("_n")).repartitionByRange("_n", *self.ids).sortWithinPartitions(
            "_n", *self.ids)
        ordered.write.partitionBy("_n").option("maxRecordsPerFile", self.file_rows).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_n", T.IntegerType())])).parquet(
            f"{self.path}/{folder}")
        name = F.array_join(F.slice(F.split(F.input_file_name(), "/"), -2, 2), "/").alias("file")
        found = written.select(name, "_n", F.struct(*self.ids).alias("key")).groupBy("file", "_n").agg(
            F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"))
        new: dict[int, list] = {}
        for r in found.select("file", "_n", "rows", F.to_json("low").alias("first"), F.to_json("high").alias("last")).orderBy(
                "_n", "low", "high").collect():  # a row a file
            new.setdefault(r["_n"], []).append(r)
        return [
            Folder(f"{folder}/{r.file}", "file", {"first": r.first, "last": r.last, "rows": r.rows,
                                                  "place": places[n] if len(own) == 1 and places[n] else [*places[n], k]})
            for n, own in new.items() for k, r in enumerate(own)]

    def write(self, rows: DataFrame) -> None:
        """Replace the table's rows."""
        old = [f.path for f in self.files()]
        self.log.commit(self._write(rows, {0: []}, F.lit(0)), old)

    def _keys(self, files: Sequence[Folder], fact: str) -> Column:
        """First or last keys of the files, as a constant array: part of the plan, not of any row."""
        return F.from_json(F.lit("[" + ",".join(f.facts[fact] for f in files) + "]"), T.ArrayType(self._key_type))

    def _key(self) -> Column:
        return F.struct(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.ids])

    def _passing(self, files: Sequence[Folder], fact: str, test: Callable[[Column], Column]) -> Column:
        """How many files' keys pass a test that holds up to some place, by halving: a step is taken if the key at its end passes."""
        keys = self._keys(files, fact)
        steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(files).bit_length()))])
        # A step beyond the end finds NULL, which passes no test.
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(test(F.get(keys, at + step - 1)), at + step).otherwise(at))

    def _with_number(self, df: DataFrame, files: Sequence[Folder]) -> DataFrame:
        """Rows with ``_n``, the file a row goes to: the first that can hold its entity, else the last before it, else the first of all."""
        ended = df.withColumn("_ended", self._passing(files, "last", lambda last: last < self._key()))
        held = F.get(self._keys(files, "first"), F.col("_ended")) <= self._key()
        return ended.withColumn("_n", F.when(held, F.col("_ended")).otherwise(F.greatest(F.col("_ended") - 1, F.lit(0)))).drop("_ended")

    def touched(self, changes: DataFrame, files: Sequence[Folder]) -> list[int]:
        """Numbers of the files that can hold a changed entity; an entity in no file's range belongs to the file before it."""
        if not files:
            return []
        spans = self._with_number(changes.select(*self.ids).distinct(), files).select(
            "_n", self._passing(files, "first", lambda first: first <= self._key()).alias("_begun"))
        numbers = spans.distinct().select(F.explode(F.sequence("_n", F.greatest(F.col("_n"), F.col("_begun") - 1))).alias("n"))
        return sorted(r.n for r in numbers.distinct().collect())  # numbers of files

    def merge(self, changes: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
        """Put ``merged(rows)`` in place of the rows of the files that the changes meet; numbers of files replaced and kept.

        The rows are all rows of every changed entity, and those of others beside them, which have to come back unchanged.
        """
        for _ in range(ATTEMPTS):
            files = self.files()
            numbers = self.touched(changes, files)
            old = [files[n] for n in numbers]
            rows = merged(self._read(old))
            if files:
                places = {n: files[n].facts["place"] for n in range(len(files))}
                new = self._write(self._with_number(rows, files), places, F.col("_n"))
            else:
                new = self._write(rows, {0: []}, F.lit(0))
            paths = [f.path for f in old]
            if self.log.commit(new, paths, needs=paths) is not None:
                return len(old), len(files) - len(old)
        raise TimeoutError(f"Other merges were always first in {self.path}")

    def upsert(self, changes: DataFrame, actor: str, **more) -> tuple[int, int]:
        """``versioned.upsert`` of the stored history."""
        return self.merge(changes, lambda rows: upsert(rows, changes, self.ids, actor, **more))
