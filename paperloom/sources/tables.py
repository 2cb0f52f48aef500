"""Stored tables whose changes rewrite only what they touch, with compare-and-set commits.

Rows lie in buckets by a hash of their key (a document's id, or the key of an append-only log). A version is a manifest,
a small JSON file that lists the files of each bucket. Files of data never change: a change writes new files for the
buckets that hold its keys and then publishes the next version's manifest, which fails if another writer has published
that version first. The loser looks at the winner's manifest: where it left the touched buckets alone, the new files
still hold and are published on top; where not, the change is made again from the new state. So no update is lost, a
failed write leaves only files that no manifest names, and readers keep the version that they began with until
``vacuum`` removes it.

Publishing needs a file system on which a rename or a hard link onto an existing name fails: HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import insertable, replaced, stale

#: Buckets of a new table, and how often a change is tried. A table keeps the number of buckets that it began with.
BUCKETS, TRIES = 64, 20
Files = dict[int, list[str]]


class Conflict(RuntimeError):
    """Others kept changing the same buckets."""


class Store:
    """A folder on any of Hadoop's file systems, seen from the driver: names, small files, and names that are taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def below(self, folder: str) -> list[str]:
        """Paths, from this folder on, of all files under ``folder``."""
        found, files = [], self.fs.listFiles(self.at(folder), True)
        root = self.fs.makeQualified(self.at("")).toUri().getPath().rstrip("/") + "/"
        while files.hasNext():
            found.append(files.next().getPath().toUri().getPath().removeprefix(root))
        return found

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Whether ``name`` was free and now has the whole text; of two that try, one gets it."""
        temporary = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getScheme() != "file":
                return bool(self.fs.rename(temporary, self.at(name)))
            local = lambda p: self.jvm.java.io.File(self.fs.makeQualified(p).toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(local(self.at(name)), local(temporary))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self.fs.delete(temporary, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "docId", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self._buckets, self.store = spark, path.rstrip("/"), schema, key, buckets, Store(spark, path)

    # versions

    def version(self) -> int:
        """The newest version; 0 if nothing was written yet."""
        return max((int(n.removesuffix(".json")) for n in self.store.names("_log") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"version": 0, "buckets": self._buckets, "files": {}, "change": "none", "touched": [], "marks": {}}
        found = json.loads(self.store.text(f"_log/{n:020}.json"))
        return found | {"files": {int(b): f for b, f in found["files"].items()}}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default, or of some buckets of it."""
        return self._rows(self.manifest(version)["files"], buckets)

    def _rows(self, files: Files, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for b, some in files.items() if buckets is None or b in buckets for f in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def history(self) -> list[dict]:
        """version, change and touched buckets of each version that is still there."""
        versions = sorted(int(n.removesuffix(".json")) for n in self.store.names("_log") if n.endswith(".json"))
        return [{k: m[k] for k in ("version", "change", "touched")} for m in map(self.manifest, versions)]

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last ``keep`` versions and files that none of these names; to be called while nothing is being written. Gives the number of files."""
        last = self.version()
        held = {f for n in range(max(1, last - keep + 1), last + 1) for some in self.manifest(n)["files"].values() for f in some}
        for name in self.store.names("_log"):
            if name.endswith(".json") and int(name.removesuffix(".json")) <= last - keep:
                self.store.delete(f"_log/{name}")
        gone = [f for f in self.store.below("data") if f not in held and not f.endswith(".crc")] if self.store.names("data") else []
        for f in gone:
            self.store.delete(f)
        return len(gone)

    # changes

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def write(self, rows: DataFrame) -> int:
        """Makes ``rows`` the table."""
        staged, buckets = f"data/{uuid.uuid4().hex}", self.manifest()["buckets"]
        new = self._written(rows, staged, buckets)
        return self._commit("write", None, lambda files: new)

    def replace(self, rows: DataFrame, broken: Column | None = None, doc: str | None = None) -> int:
        """Replaces all rows of the keys in ``rows``; nothing is written if a row breaks an invariant."""
        self._of_key(doc)
        return self._change("replace", rows, broken, lambda now, new: replaced(now, new, self.key))

    def upsert(self, rows: DataFrame, key: str | None = None) -> int:
        self._of_key(key)
        return self._change("upsert", rows, None, lambda now, new: replaced(now, new, self.key))

    def clear(self, ids: DataFrame, doc: str | None = None) -> int:
        """Removes all rows of the keys in ``ids``."""
        self._of_key(doc)
        return self._change("clear", ids.select(self.key).distinct(), None, lambda now, gone: now.join(gone, self.key, "left_anti"))

    def append(self, rows: DataFrame, parents: DataFrame | None = None, parent: str = "docId", broken: Column | None = None) -> int:
        """Adds all of ``rows`` or, if a key is there already, a parent is missing or an invariant is broken, none.

        Of the table only the keys of touched buckets are read, again only if another writer has touched them meanwhile.
        """

        def make(staged: DataFrame, touched: set[int]) -> Callable[[Files], Files]:
            added = self._written(staged, f"data/{uuid.uuid4().hex}", self.manifest()["buckets"])

            def on(files: Files) -> Files:
                first = insertable(staged, self._rows(files, touched).select(self.key), self.key, parents, parent).where("error IS NOT NULL").select(self.key, "error").first()
                if first:
                    raise ValueError(f"{first[0]}: {first[1]}")
                return {b: [*files.get(b, []), *more] for b, more in added.items()}

            return on

        return self._staged("append", rows, broken, make)

    def stale(self, rows: DataFrame) -> DataFrame:
        """Rows that ``rows`` would remove."""
        return stale(self.read(), rows)

    def migrate(self, name: str, change: Callable[[DataFrame], DataFrame], at_once: int = 16) -> tuple[int, int]:
        """Rewrites all rows by ``change``, some buckets a commit; each commit also moves a mark of this name.

        A run that was stopped goes on at the first bucket that has not been committed, one that has ended does nothing. Rows that
        ``change`` gives a ``problem`` stay as they are. Gives the rows that changed and those that stayed because of a problem.
        """
        done = stayed = 0
        while (at := self.manifest()["marks"].get(name, 0)) < (n := self.manifest()["buckets"]):
            some = set(range(at, min(n, at + at_once)))
            counts: list[int] = []

            def on(files: Files, some: set[int] = some, n: int = n, counts: list[int] = counts) -> Files:
                counts.clear()
                old = self._rows(files, some)
                if not any(files.get(b) for b in some):
                    counts.extend((0, 0))
                    return dict.fromkeys(some, [])
                names = [c.name for c in old.schema]
                made = change(old.withColumn("_old", F.struct(*names)))
                problem = F.col("problem").isNotNull() if "problem" in made.columns else F.lit(False)
                rows = made.select(F.when(problem, F.col("_old")).otherwise(F.struct(*(F.col(c).cast(old.schema[c].dataType).alias(c) for c in names))).alias("r"), problem.alias("p"), (~problem & ~F.struct(*names).eqNullSafe(F.col("_old"))).alias("d"))
                where = f"{self.path}/_staged/{uuid.uuid4().hex}"
                rows.write.parquet(where)
                rows = self.spark.read.schema(rows.schema).parquet(where)
                counts.extend(rows.agg(F.count_if("d"), F.count_if("p")).first())
                out = self._written(rows.select("r.*"), f"data/{uuid.uuid4().hex}", n)
                self.store.delete(where.removeprefix(f"{self.path}/"))
                return dict.fromkeys(some, []) | out

            self._commit(f"migrate {name}", some, on, {name: max(some) + 1})
            done, stayed = done + counts[0], stayed + counts[1]
        return done, stayed

    def _of_key(self, column: str | None) -> None:
        if column not in (None, self.key):
            raise ValueError(f"{self.path} has its rows by {self.key}, not by {column}")

    def _change(self, what: str, rows: DataFrame, broken: Column | None, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        def make(staged: DataFrame, touched: set[int]) -> Callable[[Files], Files]:
            def on(files: Files) -> Files:
                n = self.manifest()["buckets"]
                return dict.fromkeys(touched, []) | self._written(change(self._rows(files, touched), staged), f"data/{uuid.uuid4().hex}", n)

            return on

        return self._staged(what, rows, broken, make)

    def _staged(self, what: str, rows: DataFrame, broken: Column | None, make: Callable[[DataFrame, set[int]], Callable[[Files], Files]]) -> int:
        """``rows`` are computed once, so what is checked is what is written."""
        name = f"_staged/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{name}")
            staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
            first = staged.select(F.explode(broken).alias("v")).first() if broken is not None else None
            if first:
                raise ValueError(first["v"]["message"] if hasattr(first["v"], "message") else first["v"])
            # no more numbers than buckets
            touched = {r[0] for r in staged.select(self.bucket(self.manifest()["buckets"]).alias("b")).distinct().collect()}
            return self._commit(what, touched, make(staged, touched)) if touched else self.version()
        finally:
            self.store.delete(name)

    def _written(self, rows: DataFrame, folder: str, buckets: int) -> Files:
        """New files by bucket; large buckets are several files, which adaptive execution cuts."""
        dealt = rows.withColumn("_bucket", self.bucket(buckets)).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        out: Files = {}
        for f in sorted(self.store.below(folder)):
            if f.endswith(".parquet"):
                out.setdefault(int(f.rpartition("_bucket=")[2].partition("/")[0]), []).append(f)
        return out

    def _commit(self, what: str, touched: set[int] | None, make: Callable[[Files], Files], marks: dict[str, int] | None = None) -> int:
        """Publishes what ``make`` gives for the touched buckets (all, if None) on the newest version, again after each lost race."""
        made = seen = None
        for _ in range(TRIES):
            now = self.manifest()
            files = now["files"]
            held = {b: files.get(b) for b in (files if touched is None else touched)}
            if made is None or touched is not None and held != seen:
                made, seen = make(files), held
            kept = {b: f for b, f in ({} if touched is None else files).items() if b not in made} | {b: f for b, f in made.items() if f}
            new = {"version": now["version"] + 1, "buckets": now["buckets"], "change": what, "touched": sorted(kept if touched is None else touched), "marks": now["marks"] | (marks or {}), "files": kept}
            if self.store.put_new(f"_log/{now['version'] + 1:020}.json", json.dumps(new)):
                return now["version"] + 1
        raise Conflict(f"{self.path}: others changed the same buckets {TRIES} times")


class Log(BucketedTable):
    """Rows that are added once and never change, in buckets of their key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        super().__init__(spark, path, schema, key, buckets)


class Snapshot(BucketedTable):
    """Rows of documents that are replaced, document by document, by whole commits."""
