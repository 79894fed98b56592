"""Size-tiered compaction of shards under versioned manifests. DataFrame operations only.

A store is a folder. Arrivals are appended as small immutable shards (a Parquet file each). A shard is
finished once its own size reaches FULL of the target, and never before. The others are in classes that grow by
fan_in, by the bytes of the arrivals in them as these came: unlike the sizes of files, which share footers and
dictionaries once they are merged, these add up. Tiers are the upper classes; all below them are tier 0. Once a
class has a run of fan_in shards, which are thus of similar size, they
are read together, dealt to as many tasks as target-sized files hold them, and written as larger shards;
nothing is shuffled. A merged shard is in a higher class, so no row is written more
than once for each class, their number being the logarithm of arrivals' bytes; and however tiny arrivals are, none ends in a small shard that is out of reach. Runs
go on until no class has one; each leaves fewer shards. A commit writes the list of live shards as one file
and gives it the next version's name, which fails if that name exists: on a local file system by a hard
link, elsewhere by a rename that does not overwrite. So of two committers one wins and the other starts
over. Readers take the highest version; files that no manifest names are debris of lost attempts, harmless
and removable.

Defined results: an empty table commits a version without shards that reads as no rows; nulls, long texts,
repeated rows and extra columns are stored as they are.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a finished shard, and shards of one tier that are merged.
TARGET_BYTES, FAN_IN = 128 << 20, 4
#: Tiers below the finished shards, and the share of the target from which a shard is finished.
TIERS, FULL = 4, 0.5
#: bytes: of the arrivals that a shard holds, as they came.
_ENTRIES = "shard string, tier int, bytes long"


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.schema, self.target, self.fan_in = spark, path.rstrip("/"), schema, target_bytes, fan_in

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Names and sizes of the Parquet files in a folder of the store."""
        fs, p = self._fs(f"{self.path}/{folder}")
        found = [(f"{folder}/{s.getPath().getName()}", int(s.getLen())) for s in fs.listStatus(p)]
        return sorted(x for x in found if x[0].endswith(".parquet"))

    def version(self) -> int:
        """The highest committed version; 0 where there is none."""
        fs, p = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """shard, tier, bytes of the live shards."""
        version = self.version() if version is None else version
        if not version:
            return []
        return sorted(tuple(r) for r in self.spark.read.schema(_ENTRIES).json(f"{self.path}/manifests/v{version:09d}").collect())

    def commit(self, entries: list[tuple[str, int, int]], base: int) -> int:
        """Makes entries the version after base; Conflict if that exists."""
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(entries, _ENTRIES).coalesce(1).write.json(draft)
        fs, folder = self._fs(draft)
        file = next((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), None)
        if file is None:  # no entries
            file = self._fs(f"{draft}/empty")[1]
            fs.create(file, False).close()
        _, target = self._fs(f"{self.path}/manifests/v{base + 1:09d}")
        fs.mkdirs(target.getParent())
        if not self._publish(file, target):
            raise Conflict(f"version {base + 1} exists")
        fs.delete(folder, True)
        return base + 1

    def _publish(self, file, target) -> bool:
        """Gives file the name target, in one step that fails if anything has that name."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        try:
            fs, _ = self._fs(target.toString())
            if fs.getScheme() == "file":  # whose rename overwrites
                path = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(path(target), path(file))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), conf).rename(file, target, none)
        except Py4JJavaError as e:
            if any(name in e.java_exception.getClass().getName() for name in ("FileAlreadyExists", "FileAlreadyExistsException")):
                return False
            raise
        return True

    def size_class(self, size: int) -> int:
        """The power of fan_in, counted from FULL of the target, that a size reaches: 0 from there on, -1 below it and so on."""
        power, least = 0, FULL * self.target
        while max(size, 1) < least:
            power, least = power - 1, least / self.fan_in
        while size >= least * self.fan_in:
            power, least = power + 1, least * self.fan_in
        return power

    def tier(self, size: int) -> int:
        """0 for the smallest shards, TIERS for finished ones."""
        return min(TIERS, max(0, TIERS + self.size_class(size)))

    def _write(self, df: DataFrame, arrived: int | None = None) -> list[tuple[str, int, int]]:
        """Shards of the rows of df, which came as so many bytes (None: they come now)."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        files = self._files(folder)
        total = sum(size for _, size in files)
        shards = [(name, size, size if arrived is None else arrived * size // total) for name, size in files]
        return [(name, TIERS if size >= FULL * self.target else min(TIERS - 1, self.tier(came)), came) for name, size, came in shards]

    def _sizes(self, names: list[str]) -> list[int]:
        """Sizes of the files of shards."""
        known = dict(f for folder in sorted({n.rpartition("/")[0] for n in names}) for f in self._files(folder))
        return [known[n] for n in names]

    def append(self, df: DataFrame) -> int:
        """The rows of df as small shards, one for each of its partitions with rows."""
        new = self._write(df.select(*self.schema.fieldNames()))
        while True:
            base = self.version()
            try:
                return self.commit(self.manifest(base) + new, base)
            except Conflict:
                continue

    def runs(self, entries: list[tuple[str, int, int]]) -> dict[int, list[tuple[str, int, int]]]:
        """By tier, the unfinished shards of its fullest class, if they are enough to merge."""
        small: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
        for e in entries:
            if e[1] < TIERS:
                small.setdefault((e[1], self.size_class(e[2])), []).append(e)
        out: dict[int, list[tuple[str, int, int]]] = {}
        for (tier, _), run in sorted(small.items()):
            if len(run) >= max(self.fan_in, len(out.get(tier, ())) + 1):
                out[tier] = run
        return out

    def read_shards(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names))

    def compact(self) -> int:
        """One round: merges the run of each tier that has one and commits; the version now."""
        base = self.version()
        entries = self.manifest(base)
        runs = self.runs(entries)
        if not runs:
            return base
        for _, run in sorted(runs.items()):
            names = [e[0] for e in run]
            files = max(1, -(-sum(self._sizes(names)) // self.target))
            merged = self._write(self.read_shards(names).coalesce(files), sum(e[2] for e in run))
            gone = {e[0] for e in run}
            entries = [e for e in entries if e[0] not in gone] + merged
        return self.commit(entries, base)

    def settle(self) -> int:
        """Rounds until no tier has a run; a round that another committer was ahead of is done anew."""
        while True:
            before = self.version()
            try:
                if self.compact() == before:
                    return before
            except Conflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        return self.read_shards([e[0] for e in self.manifest(version)])

    def tiers(self) -> DataFrame:
        return self.spark.createDataFrame(self.manifest(), _ENTRIES)


def shard(docs: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store at path with the rows of docs, appended and compacted."""
    store = ShardStore(docs.sparkSession, path, docs.schema, target_bytes)
    store.append(docs)
    store.settle()
    return store


def placed(store: ShardStore) -> DataFrame:
    """The store's rows with the shard each is in and that shard's tier, all by one manifest."""
    entries = store.manifest()
    rows = store.read_shards([e[0] for e in entries]).withColumn("shard", F.concat_ws("/", F.lit("shards"), F.element_at(F.split(F.input_file_name(), "/"), -2), F.element_at(F.split(F.input_file_name(), "/"), -1)))
    tiers = store.spark.createDataFrame(entries, _ENTRIES).select("shard", "tier")
    return rows.join(F.broadcast(tiers) if len(entries) < 100_000 else tiers, "shard")
