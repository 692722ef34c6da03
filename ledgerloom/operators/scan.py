"""Scans of tables by column, condition, order and limit, and the writes that go with them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROGRESS, TABLES

COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "NOT": lambda c, v: c != v,
}


def condition(column: str, operator: str, value: Any) -> Column:
    """A comparison, or membership of a list for "=", "IN" and "NOT". No value is in an empty list. Values are literals, so
    nothing in them is ever read as SQL."""
    c = F.col(column)
    if isinstance(value, (list, tuple, set)):
        if operator not in ("=", "IN", "NOT", "!="):
            raise ValueError(f"{operator} takes no list")
        found = c.isin(list(value)) if value else F.lit(False)
        return ~found if operator in ("NOT", "!=") else found
    if operator not in COMPARE:
        raise ValueError(f"unknown operator {operator}")
    return COMPARE[operator](c, F.lit(value))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def scan(table: DataFrame, columns: Sequence[str] | None = None, conditions: Sequence[tuple[str, str, Any]] = (), orderby: str | None = None, order: str = "asc", limit: int | None = None, distinct: bool = False) -> DataFrame:
    """Rows that meet all conditions, projected, made distinct, ordered by one column, limited."""
    if order not in ("asc", "desc"):
        raise ValueError(f"unknown order {order}")
    out = table.where(all_of([condition(*c) for c in conditions])) if conditions else table
    if columns:
        out = out.select(*columns)
    if distinct:
        out = out.distinct()
    if orderby:
        out = out.orderBy(F.col(orderby).asc() if order == "asc" else F.col(orderby).desc())
    return out if limit is None else out.limit(limit)


def after(start: int, end: int, column: str = "block_num") -> Column:
    """Blocks after start, up to end."""
    return (F.col(column) > start) & (F.col(column) <= end)


def between(start: int, end: int, column: str = "block_num") -> Column:
    """Blocks from start, up to end."""
    return F.col(column).between(start, end)


class Store:
    """Tables of a ledger as Parquet below one folder. A write replaces a table as a whole, by a new version; an append adds
    files to the version, in order of blocks, so that a range of blocks is read from few of them. Readers see a version or
    what is added only when it is complete, so a failed write changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        """Versions that have been finished, in order."""
        where = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(where):
            return []
        found = [x.getPath() for x in self._fs.listStatus(where)]
        return sorted(int(p.getName()[1:]) for p in found if "+" not in p.getName() and self._fs.exists(self._path(p, "_SUCCESS")))

    def _added(self, name: str, version: int) -> list[int]:
        """Finished additions to a version, in order."""
        found = [x.getPath() for x in self._fs.listStatus(self._path(f"{self.folder}/{name}"))]
        return sorted(int(p.getName().split("+")[1]) for p in found if p.getName().startswith(f"v{version}+") and self._fs.exists(self._path(p, "_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        """The table, empty where it was never written."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        top = f"{self.folder}/{name}/v{versions[-1]}"
        return self.spark.read.parquet(top, *(f"{top}+{k}" for k in self._added(name, versions[-1])))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The table becomes df, which may read the table. The version before stays until the one after this is there."""
        versions = self._versions(name)
        at = versions[-1] + 1 if versions else 0
        self._by_block(name, df).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{at}")
        for old in versions[:-1]:
            for more in ["", *(f"+{k}" for k in self._added(name, old))]:
                self._fs.delete(self._path(f"{self.folder}/{name}/v{old}{more}"), True)
        return self.read(name)

    def _by_block(self, name: str, df: DataFrame) -> DataFrame:
        """df with each file a range of blocks, where the table grows by blocks: their least and greatest stand in its footer."""
        by = PROGRESS.get(name)
        return df.repartitionByRange(by).sortWithinPartitions(by) if by == "block_num" else df

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """The table with the rows of df, which may read the table; what is there is not written again."""
        if not self.exists(name):
            return self.write(name, df)
        version = self._versions(name)[-1]
        added = self._added(name, version)
        rows = df.select(*self.read(name).columns)
        self._by_block(name, rows).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{version}+{added[-1] + 1 if added else 0}")
        return self.read(name)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def len(self, name: str) -> int:
        return self.read(name).count()

    def progress(self, name: str) -> int:
        """The last block that the table has, -1 where it is empty or missing."""
        found = self.read(name).agg(F.max(PROGRESS[name])).first()[0]
        return -1 if found is None else found

    def fetch(self, name: str, **how: Any) -> DataFrame:
        return scan(self.read(name), **how)

    def sql(self, query: str, fetch: str | None = None):
        """A query over the tables as views: a frame, all rows or the first one."""
        for name in TABLES:
            if self.exists(name):
                self.read(name).createOrReplaceTempView(name)
        out = self.spark.sql(query)
        if fetch is None:
            return out
        if fetch not in ("all", "one"):
            raise ValueError(f"unknown fetch {fetch}")
        return out.collect() if fetch == "all" else out.first()
