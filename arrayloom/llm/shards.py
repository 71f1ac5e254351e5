"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards. Files of one size tier (a power
of ``fan_in``) make a run; a run of at least ``fan_in`` files is merged into
files of about ``target_bytes``. A merge is one narrow job: Spark packs small
files into read partitions, and each partition is written as one file, so no
row is shuffled. A version becomes visible by creating its manifest under a
name that mustn't exist yet, which the file system does atomically; of two
writers one fails and repeats on top of the other's version. Files are never
changed, and ``vacuum`` takes away only what no kept version names and what is
older than a time of grace, so a reader of a version is not disturbed; what a job
that died has left goes the same way.

Defined cases: an empty arrival adds a version without files; null values,
repeated rows and all columns are stored as they are, whatever their names; the
first arrival sets the columns, and another one must have them too.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    n_rows: int
    n_bytes: int
    born: int  # version that brought it


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20):
        self.root, self.target, self.fan_in, self.base = root.rstrip("/"), target_bytes, fan_in, base_bytes
        # a session of its own, whose reading sizes a merge sets
        self.spark = spark.newSession()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    # manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest(0, None, ())
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        d = json.loads(text)
        return Manifest(d["version"], d["schema"], tuple(Shard(**s) for s in d["shards"]))

    def commit(self, m: Manifest) -> None:
        """Write whole under a name of its own, then rename, which fails if the version exists."""
        text = json.dumps({"version": m.version, "schema": m.schema, "shards": [asdict(s) for s in m.shards]})
        draft = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            context.rename(draft, self._path(f"{self.root}/manifest/v{m.version:010d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(m.version) from e
            raise

    # data

    def _shards(self, folder: str, born: int) -> list[Shard]:
        """The files with rows of a folder that has been written."""
        at = self._path(f"{self.root}/{folder}")
        listed = self._fs.listStatus(at) if self._fs.exists(at) else []
        sizes = {s.getPath().getName(): s.getLen() for s in listed if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        # no column is read; input_file_name() can't clash with one
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        rows = dict(self.spark.read.parquet(f"{self.root}/{folder}").select(name.alias("f")).groupBy("f").count().collect())  # one row a file of this write
        return [Shard(f"{folder}/{n}", rows[n], b, born) for n, b in sorted(sizes.items()) if rows.get(n)]

    def _write(self, df: DataFrame, born: int) -> list[Shard]:
        folder = f"data/{born:010d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._shards(folder, born)

    def _next(self, schema: str, written: list[Shard]) -> Manifest:
        """Commit a version with these files more, on top of whatever is the latest."""
        while True:
            m = self.manifest()
            new = Manifest(m.version + 1, m.schema or schema, m.shards + tuple(written))
            try:
                self.commit(new)
                return new
            except Conflict:
                continue

    def arrive(self, df: DataFrame, part: Column, n: int) -> list[Callable[[], Manifest]]:
        """Write n arrivals in one pass over ``df``, dealt by ``part`` (0 .. n - 1); each is committed when called."""
        m = self.manifest()
        df = self._fitted(df, m)
        folder, name = f"data/{m.version + 1:010d}-{uuid.uuid4().hex}", f"part-{uuid.uuid4().hex}"
        df.select(*[F.col(f"`{c}`") for c in df.columns], part.alias(name)).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
        return [lambda k=k: self._next(df.schema.json(), self._shards(f"{folder}/{name}={k}", self.manifest().version + 1)) for k in range(n)]

    def _fitted(self, df: DataFrame, m: Manifest) -> DataFrame:
        if m.schema is None:
            return df
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromJson(json.loads(m.schema))])

    def append(self, df: DataFrame) -> Manifest:
        m = self.manifest()
        df = self._fitted(df, m)
        return self._next(df.schema.json(), self._write(df, m.version + 1))

    def tier(self, s: Shard) -> int:
        return max(0, floor(log(max(s.n_bytes, 1) / self.base, self.fan_in)) + 1) if s.n_bytes >= self.base else 0

    def runs(self, m: Manifest) -> list[list[Shard]]:
        """The files to merge: tiers below the target with enough files."""
        by_tier: dict[int, list[Shard]] = {}
        for s in m.shards:
            if 2 * s.n_bytes <= self.target:
                by_tier.setdefault(self.tier(s), []).append(s)
        return [v for _, v in sorted(by_tier.items()) if len(v) >= self.fan_in]

    def compact(self) -> Manifest:
        """Merge every full run once; the latest manifest is returned."""
        m = self.manifest()
        for run in self.runs(m):
            conf = self.spark.conf
            conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
            conf.set("spark.sql.files.openCostInBytes", "0")
            conf.set("spark.sql.files.minPartitionNum", "1")
            schema = StructType.fromJson(json.loads(m.schema))
            merged = self._write(self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]), m.version + 1)
            if sum(s.n_rows for s in merged) != sum(s.n_rows for s in run):
                raise RuntimeError("a merge lost rows")
            while True:
                now = self.manifest()
                if not set(run) <= set(now.shards):
                    break  # merged by another writer meanwhile
                try:
                    m = Manifest(now.version + 1, now.schema, tuple(s for s in now.shards if s not in set(run)) + tuple(merged))
                    self.commit(m)
                    break
                except Conflict:
                    continue
        return self.manifest()

    def vacuum(self, keep_versions: int = 1, grace_seconds: float = 7 * 24 * 3600) -> int:
        """Delete old versions, and files that no kept version names; the number of files.

        A version is kept while it is one of the last ``keep_versions`` or was the
        latest within the time of grace, as readers may have begun on it; a file
        stays for that time after it was written, as its commit may be under way.
        """
        now = time.time() * 1000
        made = {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))}
        known = self.versions()
        replaced = {v: made[f"v{w:010d}.json"] for v, w in zip(known, known[1:], strict=False)}
        kept = [v for v in known if v in known[-keep_versions:] or now - replaced[v] < 1000 * grace_seconds]
        named = {s.path for v in kept for s in self.manifest(v).shards}
        gone, data = 0, self._path(f"{self.root}/data")
        files = self._fs.listFiles(data, True) if self._fs.exists(data) else None
        old = []
        while files is not None and files.hasNext():
            f = files.next()
            path = f.getPath().toString().rsplit(f"{self.root.rsplit('/', 1)[1]}/data/", 1)[1]
            if f"data/{path}" not in named and now - f.getModificationTime() >= 1000 * grace_seconds:
                old.append(f.getPath())
        for p in old:
            gone += p.getName().endswith(".parquet")
            self._fs.delete(p, False)
        for v in set(known) - set(kept):
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:010d}.json"), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in m.shards])


def ingest(docs: DataFrame, store: ShardStore, n_arrivals: int = 8, id_column: str = "doc_id") -> Manifest:
    """Append arrival by arrival (dealt by a hash of the id), compacting whenever a run is full.

    ``docs`` is read once. Old versions stay readable until ``vacuum``.
    """
    part = F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(n_arrivals))
    for k, commit in enumerate(store.arrive(docs, part, n_arrivals)):
        commit()
        if (k + 1) % store.fan_in == 0:
            store.compact()
    return store.compact()
