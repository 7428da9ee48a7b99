"""Sharding by size-tiered compaction under versioned manifests.

``append`` writes arrivals as small immutable shards, one file each, as they come: no row is moved.  A shard's tier is how often its size fits a factor
``FANOUT`` above ``BASE_BYTES``.  ``compact`` takes the live shards of a tier in order of arrival, cuts them into groups of about the target size, and
merges every group of ``FANOUT`` shards or more into one file; a merged shard has a higher tier, and tiers are gone through until no such group is left.  Shards of
half the target or more are finished.

A manifest is a table of the live shards and a small file ``v<number>`` that names it.  The file is written beside its final name and renamed,
which fails if that version exists: of two writers one commits, and the other starts again from the newer version: an append names its shards in that
one, a compaction gives way if one of the shards that it merged is gone.  A reader takes the highest version.  What no manifest names is left over from writers that failed or gave
way; ``vacuum`` removes it once it is old enough not to be a running writer's.

All of it is DataFrame operations.  Plans are tables too: windows over shards, cut into stretches of ``STRETCH`` of them; the driver lists the paths of
``GROUPS`` merges at a time.  Each merge's rows go to a partition of their own, so a task writes one target-sized file, and a hot source is spread like any other.  Null ids and texts are rows like any other; repeated rows are
kept; very long texts make a shard larger, not longer to plan; equally sized shards are taken in order of arrival; an empty table commits a manifest without new
shards; other columns are stored too, and clashing names are no matter, as a merge reads and writes whole rows by place.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.common import free_name

#: Rows of an arrival at most; bytes of a file of tier 0, below ``FANOUT`` times as many, and of a finished one; and how many shards are merged at least.
ARRIVAL_ROWS, BASE_BYTES, TARGET_BYTES, FANOUT = 2000, 1 << 20, 32 << 20, 4
#: Shards that are planned together; merges that one job does.
STRETCH, GROUPS = 65_536, 4096
#: Seconds for which files that no manifest names may be a running writer's.
GRACE = 86_400

_SHARDS = "seq long, path string, rows long, bytes long, tier int"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Store:
    """A folder of shards and manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        for folder in ("manifests", "tables", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _names(self, folder: str) -> list[tuple[str, int]]:
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n, _ in self._names("manifests") if n.startswith("v"))

    def manifest(self, version: int | None = None) -> tuple[int, DataFrame]:
        """A version, the last by default, and its shards (``_SHARDS``) in order of arrival; version 0 has none."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, _table(self.spark, [], _SHARDS)
        name = self.spark.read.text(f"{self.root}/manifests/v{version}").first()[0]
        return version, self.spark.read.schema(_SHARDS).parquet(f"{self.root}/tables/{name}")

    def commit(self, base: int, shards: DataFrame) -> int:
        """Make ``shards`` the live ones, if nobody has committed since version ``base``; the new version."""
        table = uuid.uuid4().hex
        shards.select(*[f.split()[0] for f in _SHARDS.split(", ")]).write.parquet(f"{self.root}/tables/{table}")
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        final, part = self._path(f"{self.root}/manifests/v{base + 1}"), self._path(f"{self.root}/manifests/.{table}")
        out = self._fs.create(part, False)
        out.write(bytearray(table.encode()))
        out.close()
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf).rename(part, final, options)
        except Exception as e:  # py4j wraps whatever the file system throws
            self._fs.delete(part, False)
            self._fs.delete(self._path(f"{self.root}/tables/{table}"), True)
            if not self._fs.exists(final):
                raise
            raise Conflict(f"version {base + 1} exists") from e
        return base + 1

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or None if it has no shards."""
        paths = [r[0] for r in self.manifest(version)[1].orderBy("seq").select("path").collect()]  # what a reader of files lists in any case
        return self.spark.read.parquet(*[f"{self.root}/data/{p}" for p in paths]) if paths else None

    def vacuum(self, grace: int = GRACE, keep: int | None = None) -> int:
        """Remove the data that no manifest names and that is older than ``grace`` seconds, and the manifests but the last ``keep``; how many files and folders went."""
        gone = 0
        versions = self.versions()
        for v in versions[: -keep] if keep else []:
            gone += self._fs.delete(self._path(f"{self.root}/manifests/v{v}"), False)
        versions = versions[-keep:] if keep else versions
        live, tables = None, set()
        for v in versions:
            shards = self.manifest(v)[1].select("path")
            live = shards if live is None else live.unionByName(shards)
            tables.add(self.spark.read.text(f"{self.root}/manifests/v{v}").first()[0])
        before = (time.time() - grace) * 1000
        for n, at in self._names("tables"):
            if n not in tables and at <= before:
                gone += self._fs.delete(self._path(f"{self.root}/tables/{n}"), True)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.root}/data")
        files = files.where(F.col("modificationTime") <= F.timestamp_millis(F.lit(int(before)))).select(_relative(F.col("path")).alias("path"))
        dead = files if live is None else files.join(live.distinct(), "path", "left_anti")
        for r in dead.toLocalIterator():
            gone += self._fs.delete(self._path(f"{self.root}/data/{r[0]}"), False)
        return gone


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a table that the JVM makes by itself."""
    kind = f"array<struct<{schema.replace(', ', ',').replace(' ', ':')}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def _relative(path):
    return F.regexp_extract(path, r"/data/([^/]+/[^/]+)$", 1)


def _tier(size, fanout: int):
    return F.when(size < BASE_BYTES, 0).otherwise(F.floor(F.log(float(fanout), size / F.lit(float(BASE_BYTES))) + F.lit(1e-9))).cast("int")


def _measured(store: Store, folder: str, fanout: int) -> DataFrame:
    """(path, rows, bytes, tier) of the files in a folder of ``data``: no column of theirs is read."""
    files = store.spark.read.parquet(f"{store.root}/data/{folder}").select("_metadata.file_path", "_metadata.file_size")
    out = files.groupBy(F.col("file_path").alias("path"), F.col("file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return out.select(_relative(F.col("path")).alias("path"), "rows", F.col("bytes").cast("long").alias("bytes"), _tier(F.col("bytes"), fanout).alias("tier"))


def append(store: Store, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS, fanout: int = FANOUT) -> int:
    """Write ``rows`` as small shards and commit them after the live ones; the new version.  If another writer commits first, they come after that one's."""
    folder = uuid.uuid4().hex
    rows.write.option("maxRecordsPerFile", arrival_rows).parquet(f"{store.root}/data/{folder}")
    new = _measured(store, folder, fanout)
    while True:
        base, shards = store.manifest()
        first = (shards.agg(F.max("seq")).first()[0] or 0) + 1
        # numbered by path: tasks and their files in order
        stretch = F.pmod(F.xxhash64("path"), F.lit(64))
        number = (F.row_number().over(Window.partitionBy(stretch).orderBy("path")) - 1) * 64 + stretch + first
        try:
            return store.commit(base, shards.unionByName(new.withColumn("seq", number.cast("long"))))
        except Conflict:
            continue


def plan(shards: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(seq, path, rows, bytes, tier, into) of the shards to merge: of a tier, in order, groups of about the target, of ``fanout`` shards at least.  ``into``: the group's first
    ``seq``."""
    open_ = shards.where(F.col("bytes") * 2 < target)
    rank = F.row_number().over(Window.partitionBy("tier", F.pmod("seq", F.lit(64))).orderBy("seq"))
    open_ = open_.withColumn("stretch", F.floor(rank * 64 / STRETCH))
    w = Window.partitionBy("tier", "stretch").orderBy("seq")
    cut = open_.withColumn("cut", F.floor((F.sum("bytes").over(w) - F.col("bytes") / 2) / target))
    g = Window.partitionBy("tier", "stretch", "cut")
    out = cut.select("*", F.count("*").over(g).alias("n"), F.min("seq").over(g).alias("into"))
    return out.where(F.col("n") >= fanout).drop("stretch", "cut", "n")


def compact(store: Store, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
    """Merge shards, tier by tier, until no group is left to merge; the last version.  Each round commits a version of its own."""
    while True:
        base, shards = store.manifest()
        merges = plan(shards, target, fanout).persist()
        try:
            into = [r[0] for r in merges.select("into").distinct().orderBy("into").limit(GROUPS).collect()]
            if not into:
                return base
            parts = merges.where(F.col("into").between(into[0], into[-1])).collect()  # of GROUPS merges
        finally:
            merges.unpersist()
        folder = _merge(store, [(r["path"], into.index(r["into"])) for r in sorted(parts, key=lambda r: r["seq"])], len(into))
        # a file of partition p is that of the p-th merge
        new = _measured(store, folder, fanout).withColumn("p", F.regexp_extract("path", r"/part-(\d+)-", 1).cast("int"))
        seq = F.element_at(F.split(F.lit(",".join(map(str, into))), ","), F.col("p") + 1).cast("long")
        old = _table(store.spark, [{"path": r["path"]} for r in parts], "path string")
        while True:
            if shards.join(old, "path", "left_semi").count() < len(parts):
                break  # another compaction was first: its version is planned anew
            try:
                store.commit(base, shards.join(old, "path", "left_anti").unionByName(new.withColumn("seq", seq).drop("p")))
                break
            except Conflict:
                base, shards = store.manifest()


def _merge(store: Store, parts: list[tuple[str, int]], n: int) -> str:
    """Write the rows of shards (path, merge) as a file for each of ``n`` merges; the folder."""
    spark, folder = store.spark, uuid.uuid4().hex
    rows = spark.read.parquet(*[f"{store.root}/data/{p}" for p, _ in parts])
    place, path = free_name(rows, "merge"), free_name(rows, "path")
    where = _table(spark, [{path: p, place: i} for p, i in parts], f"{path} string, {place} int")
    columns = rows.columns
    tagged = rows.withColumn(path, _relative(F.col("_metadata.file_path"))).join(where, path)
    moved = tagged.repartitionById(n, F.col(place)).select(*columns)
    moved.write.option("maxRecordsPerFile", 0).parquet(f"{store.root}/data/{folder}")
    return folder


def layout(store: Store, version: int | None = None) -> DataFrame:
    """(doc_id, version, shard, shard_rows, shard_bytes, tier) of every row of a version, in shards numbered in order of arrival from 0."""
    version, shards = store.manifest(version)
    number = Window.partitionBy("stretch").orderBy("seq")
    low = shards.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    per = low.groupBy("stretch").agg(F.count("*").alias("m"))
    before = per.select("stretch", F.coalesce(F.sum("m").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each stretch
    named = low.join(before, "stretch").select("path", (F.col("before") + F.row_number().over(number) - 1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.col("tier").cast("long").alias("tier"))
    rows = store.read(version)
    if rows is None:
        return named.select(F.lit(None).cast("long").alias("doc_id"), F.lit(version).cast("long").alias("version"), "shard", "shard_rows", "shard_bytes", "tier")
    at = rows.select(F.col("doc_id").cast("long").alias("doc_id"), _relative(F.col("_metadata.file_path")).alias("path"))
    return at.join(named, "path").select("doc_id", F.lit(version).cast("long").alias("version"), "shard", "shard_rows", "shard_bytes", "tier")
