"""Stored tables whose files a snapshot lists, so that months can be merged and readers need no listing.

A table has data files below ``data``, a list of files for each month below ``months`` (Parquet: file, batch, first and last
time, rows), and numbered snapshots, each a small text that names the newest list of every month. A change writes new files
and new lists of the months it touches, then the next snapshot; creating that text is the commit, and fails where another
change came first. Readers take the newest snapshot, its months within the times asked for, and of their files those whose
times overlap: nothing is found by listing folders. Files that no snapshot needs are removed by :meth:`SnapshotTable.clean`.

A batch written again replaces its rows. Merging leaves the newest batch alone, as a stream replays only that one.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalar import moment
from flowlens.sources.storage import MONTH, _delete, _glob, laid_out, retain

#: Rows without a time are in this month and have no age.
NO_MONTH = "none"
_FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("batch", T.LongType()),
                       T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType()),
                       T.StructField("rows", T.LongType())])


#: Bytes of rows that a task sorts at most for one file, about.
TASK_BYTES = 512 << 20


def row_bytes(schema: T.StructType) -> int:
    """About the bytes of a row that is sorted: 16 for a column, and 32 more for one of no fixed width."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    return sum(16 if isinstance(f.dataType, fixed) else 48 for f in schema.fields)


class Conflict(RuntimeError):
    """Another change was committed meanwhile; the snapshot is as that change left it."""


@dataclass(frozen=True)
class SnapshotTable:
    """A table of rows of ``schema`` below ``path``, by month of ``ts``, in ``order`` inside its files."""

    spark: SparkSession
    path: str
    schema: T.StructType
    ts: str
    order: Sequence[str]

    def _at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    # ----------------------------------------------------------------------- snapshots

    def snapshot(self) -> dict:
        """The newest snapshot: number, newest batch, and for each month its list, files, and batches merged for good."""
        found = _glob(self.spark, f"{self._at('snapshots')}/*.json")
        if not found:
            return {"number": 0, "newest": -1, "months": {}}
        return json.loads(self.spark.read.text(found[-1], wholetext=True).first()[0])

    def _commit(self, before: dict, months: dict, newest: int | None = None) -> dict:
        after = {"number": before["number"] + 1, "newest": before["newest"] if newest is None else newest, "months": months}
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self._at('snapshots')}/{after['number']:012d}.json")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = files.create(path, False)  # fails where the number is taken
        except Exception as error:
            if files.exists(path):
                raise Conflict(f"snapshot {after['number']} of {self.path} is there already") from error
            raise
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        return after

    def _written(self, rows: DataFrame, batch: int, dealt: bool = False) -> dict[str, DataFrame]:
        """Write rows as new data files; for each month the list of them."""
        folder = f"{self._at('data')}/{uuid.uuid4().hex}"
        laid_out(rows.select(*self.schema.names), self.ts, self.order, dealt=dealt).write.partitionBy(MONTH).parquet(folder)
        stored = T.StructType([*self.schema.fields, T.StructField(MONTH, T.IntegerType())])
        files = self.spark.read.schema(stored).parquet(folder).groupBy(
            F.coalesce(F.col(MONTH).cast("string"), F.lit(NO_MONTH)).alias("month"), F.col("_metadata.file_path").alias("file")
        ).agg(F.min(self.ts).alias("first"), F.max(self.ts).alias("last"), F.count(F.lit(1)).alias("rows"))
        files = files.withColumn("batch", F.lit(batch).cast("long")).persist()
        months = [r["month"] for r in files.select("month").distinct().collect()]
        return {m: files.filter(F.col("month") == m).select(*_FILES.names) for m in months}

    def _listed(self, months: Sequence[dict]) -> DataFrame:
        paths = [m["list"] for m in months]
        return self.spark.read.schema(_FILES).parquet(*paths) if paths else self.spark.createDataFrame([], _FILES)

    def _month(self, files: DataFrame, merged: int) -> dict | None:
        """Store the list of one month; None for a month without files."""
        path = f"{self._at('months')}/{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(path)
        count = self.spark.read.schema(_FILES).parquet(path).count()
        return {"list": path, "files": count, "merged": merged} if count else None

    # ----------------------------------------------------------------------- changes

    def append(self, rows: DataFrame, batch: int, dealt: bool = False) -> dict:
        """Add one batch, or replace it. Lists of other months are not read. Runs jobs.

        ``dealt``: the rows lie in ranges of the order already.
        """
        before = self.snapshot()
        months = dict(before["months"])
        new = self._written(rows, batch, dealt)
        again = [m for m in months if m not in new] if batch <= before["newest"] else []  # the batch may have had other months
        for month in [*new, *again]:
            known = months.get(month)
            if known and batch <= known["merged"]:
                continue  # its rows are in merged files
            files = new.get(month, self.spark.createDataFrame([], _FILES))
            if known:
                files = self._listed([known]).filter(F.col("batch") != batch).unionByName(files)
            months[month] = self._month(files, known["merged"] if known else -1)
        return self._commit(before, {m: v for m, v in months.items() if v}, max(batch, before["newest"]))

    def merge(self, until: dt.datetime, files: int = 1, rows: int = 5_000_000) -> dict:
        """Rewrite the months that ended before ``until`` and have more than ``files`` files, in ranges of the order.

        About ``rows`` rows a file, and no more than a task sorts in TASK_BYTES. The newest batch stays as it is. Runs jobs for each such month.
        """
        before = self.snapshot()
        months = dict(before["months"])
        last = before["newest"] - 1
        for month in sorted(m for m in months if m != NO_MONTH and int(m) < until.year * 100 + until.month):
            known = months[month]
            if known["files"] <= files:
                continue
            listed = self._listed([known]).persist()
            due = listed.filter(F.col("batch") <= last)
            total = due.agg(F.sum("rows"), F.count(F.lit(1))).first()
            if total[1] > files:
                count = max(files, -(-total[0] // rows), -(-total[0] * row_bytes(self.schema) // TASK_BYTES))
                made = self._merged(self._read([r["file"] for r in due.select("file").collect()]), last, count)
                months[month] = self._month(listed.filter(F.col("batch") > last).unionByName(made), last)
            listed.unpersist()
        return before if months == before["months"] else self._commit(before, months)

    def _merged(self, rows: DataFrame, batch: int, count: int) -> DataFrame:
        folder = f"{self._at('data')}/{uuid.uuid4().hex}"
        laid_out(rows, self.ts, self.order, count).write.partitionBy(MONTH).parquet(folder)
        return self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(self.ts).alias("first"), F.max(self.ts).alias("last"), F.count(F.lit(1)).alias("rows")).withColumn(
            "batch", F.lit(batch).cast("long")).select(*_FILES.names)

    def expire(self, days: int, now: dt.datetime) -> dict:
        """Drop rows older than ``days``. Months before the cut leave the snapshot unread; the cut's files are rewritten."""
        before = self.snapshot()
        cut = now - dt.timedelta(days=days)
        at = f"{cut.year * 100 + cut.month}"
        months = {m: v for m, v in before["months"].items() if m == NO_MONTH or int(m) >= int(at)}
        known = months.get(at)
        if known:
            listed = self._listed([known])
            old = listed.filter(F.col("first") < moment(cut)).orderBy("batch", "file").collect()
            if old:
                files = listed.filter(F.col("first") >= moment(cut))
                for batch in sorted({r["batch"] for r in old}):
                    left = retain(self._read([r["file"] for r in old if r["batch"] == batch]), self.ts, days, moment(now))
                    files = files.unionByName(self._written(left, batch).get(at, self.spark.createDataFrame([], _FILES)))
                months[at] = self._month(files, known["merged"])
        months = {m: v for m, v in months.items() if v}
        return before if months == before["months"] else self._commit(before, months)

    def clean(self) -> int:
        """Remove data, lists and snapshots that the newest snapshot does not need; returns how many paths went.

        For times without readers of older snapshots and without changes under way.
        """
        now = self.snapshot()
        held = {f["file"] for f in self._listed(list(now["months"].values())).select("file").toLocalIterator()}
        lists = {m["list"].rsplit("/", 1)[1] for m in now["months"].values()}
        gone = [p for p in _glob(self.spark, f"{self._at('months')}/*") if p.rsplit("/", 1)[1] not in lists]
        gone += [p for p in _glob(self.spark, f"{self._at('snapshots')}/*.json") if int(p.rsplit("/", 1)[1][:-5]) < now["number"]]
        names = {f.split("/data/", 1)[1] for f in held}
        gone += [p for p in _glob(self.spark, f"{self._at('data')}/*/*/*.parquet") if p.split("/data/", 1)[1] not in names]
        for path in gone:
            _delete(self.spark, path)
        return len(gone)

    # ----------------------------------------------------------------------- reading

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def files(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> list[str]:
        """The files that hold rows with ``since`` < time <= ``until``."""
        months = {m: v for m, v in self.snapshot()["months"].items()
                  if (since is None or (m != NO_MONTH and int(m) >= since.year * 100 + since.month))
                  and (until is None or (m != NO_MONTH and int(m) <= until.year * 100 + until.month))}
        listed = self._listed(list(months.values()))
        if since is not None:
            listed = listed.filter(F.col("last") > moment(since))
        if until is not None:
            listed = listed.filter(F.col("first") <= moment(until))
        return [r["file"] for r in listed.select("file").orderBy("file").collect()]

    def read(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """The rows with ``since`` < time <= ``until``."""
        rows = self._read(self.files(since, until))
        if since is not None:
            rows = rows.filter(F.col(self.ts) > moment(since))
        return rows if until is None else rows.filter(F.col(self.ts) <= moment(until))
