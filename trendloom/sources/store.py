"""Tables in partitions, several of them committed together under one log.

Every commit writes its partitions to folders of its own version and then one small file of the log. A reader takes
the versions from the log alone, so a commit is seen whole or not at all, a failed one leaves nothing that is read,
and a batch that comes again is known by its name. A partition is replaced (its rows are those of one version) or appended to
(those of several versions). A rollback is a commit, too: it takes the versions after a given one out of the log's account.

    path/<table>/_v=<version>/<partition column>=<value>/*.parquet     rows
    path/_log/_v=<version>/*.parquet                                   (op, tbl, part, batch, upto)

One writer at a time. The log holds a row for each partition of each commit and is read by the driver: partitions are
days or hash buckets, not keys. Readers open the folders of the partitions they ask for and no others.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "op string, tbl string, part string, batch string, upto long"


@dataclass
class Change:
    """rows to write into partitions of column `part`; touched ones are replaced even if no row is left in them."""

    rows: DataFrame
    part: str
    append: bool = False
    touched: list[str] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[str, list] = {}  # log folders never change: each is read once
        self._held: dict[tuple[str, int], set[str]] = {}  # nor do the rows of a committed version: each is listed once

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def log(self) -> list:
        """All commits' rows (v, op, tbl, part, batch, upto), oldest first."""
        folders = [n for n in self._names(f"{self.path}/_log") if n.startswith("_v=")]
        new = [n for n in folders if n not in self._known]
        if new:
            read = self.spark.read.option("basePath", f"{self.path}/_log").schema(f"{LOG}, _v long")
            rows = read.parquet(*[f"{self.path}/_log/{n}" for n in new]).withColumnRenamed("_v", "v").collect()
            self._known |= {n: [r for r in rows if r["v"] == int(n[3:])] for n in new}
        return sorted((r for n in folders for r in self._known[n]), key=lambda r: (r["v"], r["tbl"] or "", r["part"] or ""))

    def effective(self) -> list:
        """The log's rows that rollbacks have left."""
        out: list = []
        for r in self.log():
            if r["op"] == "rollback":
                out = [o for o in out if o["v"] <= r["upto"]]
            else:
                out.append(r)
        return out

    def version(self) -> int:
        """The latest version that counts, 0 before the first commit."""
        return max((r["v"] for r in self.effective()), default=0)

    def has(self, batch: str) -> bool:
        return any(r["batch"] == batch for r in self.effective())

    def parts(self, table: str) -> dict[str, list[int]]:
        """The versions that make up each partition of a table."""
        out: dict[str, list[int]] = {}
        for r in self.effective():
            if r["tbl"] == table and r["part"] is not None:
                out[r["part"]] = ([*out.get(r["part"], []), r["v"]]) if r["op"] == "append" else [r["v"]]
        return out

    def read(self, table: str, schema: str | StructType, part: str, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of the given partitions, of all by default; `part` is one of the columns of schema."""
        stored = self.parts(table)
        wanted = stored if parts is None else {p: stored[p] for p in map(str, parts) if p in stored}
        for v in {v for versions in wanted.values() for v in versions} - {v for t, v in self._held if t == table}:
            self._held[table, v] = set(self._names(f"{self.path}/{table}/_v={v}"))
        held = lambda p, v: f"{part}={p}" in self._held[table, v]  # noqa: E731  a partition may have lost its last row
        paths = [f"{self.path}/{table}/_v={v}/{part}={p}" for p, versions in sorted(wanted.items()) for v in versions if held(p, v)]
        typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not paths:
            return self.spark.createDataFrame([], typed)
        read = self.spark.read.schema(StructType([*typed.fields]).add("_v", "long")).option("basePath", f"{self.path}/{table}")
        return read.parquet(*paths).select(*typed.names)

    def commit(self, changes: dict[str, Change], batch: str | None = None) -> int:
        """Write all changes and then the log; the version that holds them. A batch that was committed before changes nothing."""
        if batch is not None and self.has(batch):
            return self.version()
        v = max((r["v"] for r in self.log()), default=0) + 1
        rows = []
        for table, c in changes.items():
            folder = f"{self.path}/{table}/_v={v}"
            c.rows.hint("rebalance", F.col(c.part)).write.mode("overwrite").partitionBy(c.part).parquet(folder)  # splits a large partition, joins small ones
            written = [n.split("=", 1)[1] for n in self._names(folder) if n.startswith(f"{c.part}=")]
            rows += [("append" if c.append else "replace", table, p, batch, None) for p in sorted({*written, *(() if c.append else c.touched)})]
        self._append(v, rows or [("replace", None, None, batch, None)])
        return v

    def rollback(self, upto: int) -> int:
        """Take the versions after `upto` out; later commits build on what is left."""
        v = max((r["v"] for r in self.log()), default=0) + 1
        self._append(v, [("rollback", None, None, None, upto)])
        return v

    def _append(self, v: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_log/_v={v}")  # one file: seen whole or not

    def compact(self, table: str, schema: str | StructType, part: str, most: int = 8, merged=None) -> bool:
        """Rewrite partitions that consist of more than `most` versions as one; `merged` may combine their rows first."""
        long = [p for p, versions in self.parts(table).items() if len(versions) > most]
        if not long:
            return False
        rows = self.read(table, schema, part, long)
        self.commit({table: Change(merged(rows) if merged else rows, part, touched=long)})
        return True

    def vacuum(self) -> int:
        """Delete row folders that no version in the account uses; earlier versions cannot be rolled back to afterwards."""
        tables = {r["tbl"] for r in self.effective() if r["tbl"]}
        used = {(t, v) for t in tables for versions in self.parts(t).values() for v in versions}
        gone = 0
        for table in (n for n in self._names(self.path) if not n.startswith("_")):
            for n in self._names(f"{self.path}/{table}"):
                if n.startswith("_v=") and (table, int(n[3:])) not in used:
                    p, fs = self._fs(f"{self.path}/{table}/{n}")
                    gone += bool(fs.delete(p, True))
        return gone


def bucket(keys: list[str], n: int) -> Column:
    """A hash bucket of the keys, from 0."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n)).cast("int")
