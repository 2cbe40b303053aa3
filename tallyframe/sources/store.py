"""A table store of Parquet folders partitioned by company, with replacement, deletion and update of whole companies or rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class TableStore:
    """Tables under `root`, each written as new generations: a reader sees one generation, a failed write leaves the old one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(conf), path

    def _current(self, name: str) -> dict | None:
        fs, path = self._fs()
        mark = path(f"{self.root}/{name}/CURRENT")
        if not fs.exists(mark):
            return None
        s = fs.open(mark)
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def exists(self, name: str) -> bool:
        """Whether the table has been written."""
        return self._current(name) is not None

    def read(self, name: str, companies: Sequence[int] | None = None) -> DataFrame:
        """The table, of some companies only (their partitions alone are read)."""
        now = self._current(name)
        if now is None:
            raise KeyError(name)
        schema = StructType.fromJson(now["schema"])
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{now['generation']}").select(schema.names)
        return df if companies is None else df.where(F.col("company_id").isin(list(companies)))

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the whole table."""
        g = uuid.uuid4().hex
        w = df.write.partitionBy("company_id") if "company_id" in df.columns and len(df.columns) > 1 else df.write
        w.parquet(f"{self.root}/{name}/{g}")
        fs, path = self._fs()
        # the pointer is written aside and moved, so that a reader or a crash never meets half of one
        aside, mark = path(f"{self.root}/{name}/CURRENT.{g}"), path(f"{self.root}/{name}/CURRENT")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps({"generation": g, "schema": df.schema.jsonValue()}).encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(mark.toUri(), self.spark._jsc.hadoopConfiguration())
        renames = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(aside), fs.makeQualified(mark), renames)

    def clean(self, name: str) -> int:
        """Remove the generations that are no longer current; how many there were. Not while others read them."""
        now = self._current(name)
        if now is None:
            return 0
        fs, path = self._fs()
        old = [f.getPath() for f in fs.listStatus(path(f"{self.root}/{name}")) if f.isDirectory() and f.getPath().getName() != now["generation"]]
        for p in old:
            fs.delete(p, True)
        return len(old)

    def replace_companies(self, name: str, df: DataFrame, companies: Sequence[int]) -> None:
        """Replace all rows of `companies`; a company without new rows ends with none, others stay as they are."""
        new = df.where(F.col("company_id").isin(list(companies)))
        if self.exists(name):
            new = self.read(name).where(~F.col("company_id").isin(list(companies))).unionByName(new, allowMissingColumns=True)
        self.write(name, new)

    def delete(self, name: str, which: Column) -> None:
        """Delete rows; rows for which `which` is null stay."""
        self.write(name, self.read(name).where(~F.coalesce(which, F.lit(False))))

    def delete_unreferenced(self, name: str, which: Column, key: str, children: Mapping[str, str]) -> None:
        """Delete rows unless one of them is referred to: `children` names tables and their columns that hold `key`. ValueError then, KeyError if there is no such row."""
        gone = self.read(name).where(which).select(F.col(key).alias("__k"))
        if gone.isEmpty():
            raise KeyError(name)
        for child, column in children.items():
            if self.exists(child) and not self.read(child).join(gone, F.col(column) == F.col("__k"), "left_semi").isEmpty():
                raise ValueError(f"rows of {child} refer to {name}")
        self.delete(name, which)

    def upsert(self, name: str, df: DataFrame, key: Sequence[str]) -> None:
        """Insert rows, replacing those of equal key."""
        self.write(name, upserted(self.read(name), df, key) if self.exists(name) else df)

    def update(self, name: str, which: Column, changes: Mapping[str, object]) -> None:
        """Set columns of some rows; None leaves a column as it is. A column `updated_at` is set to now in them."""
        old = self.read(name)
        self.write(name, updated(old, which, changes, "updated_at" if "updated_at" in old.columns else None))


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal key, and the others added."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def updated(df: DataFrame, which: Column, changes: Mapping[str, object], stamp: str | None = None) -> DataFrame:
    """`df` with columns set where `which` holds; None leaves a column as it is. `stamp` names a column to set to now."""
    sets = {c: F.when(which, F.lit(v).cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c, v in changes.items() if v is not None}
    if stamp and sets:
        sets[stamp] = F.when(which, F.current_timestamp().cast(dict(df.dtypes)[stamp])).otherwise(F.col(stamp))
    return df.withColumns(sets) if sets else df


def get_or_create(existing: DataFrame, wanted: DataFrame, key: Sequence[str], owner: str) -> DataFrame:
    """What becomes of each distinct wanted (key, owner): `exists`, `conflict` (the key belongs to another owner) or `created`.

    Of several owners that want the same new key the least gets it and the others conflict. Rows with a null in the key are left out.
    """
    there = existing.select(*key, F.col(owner).alias("__has")).groupBy(*key).agg(F.min("__has").alias("__has"))
    want = wanted.select(*key, owner).distinct().where(" and ".join(f"{k} is not null" for k in key))
    first = want.groupBy(*key).agg(F.min(owner).alias("__first"))
    j = want.join(there, list(key), "left").join(first, list(key))
    verdict = F.when(F.col("__has") == F.col(owner), "exists").when(F.col("__has").isNotNull() | (F.col(owner) != F.col("__first")), "conflict").otherwise("created")
    return j.select(*key, owner, verdict.alias("verdict"))
