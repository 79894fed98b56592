"""Rows by key in hashed buckets, with versions: what a batch touches is read and written, nothing else.

A key's bucket is a hash of it, so a batch reads only the buckets of its own keys. Data files are never changed: a version is a
small JSON file that names, for each bucket, the folders that hold its rows, and a new version appears at once, when its
file is published under the next number, which only one writer can do. A writer that comes second starts from what the other
has published, with the rows that it has written already. Old versions stay readable.

The manifest grows with buckets and with the additions since a bucket was last rewritten, not with rows.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class KeyedTable:
    """A table under path with a key of one or more columns. The number of buckets is fixed by the first version."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        known = self.version()
        self.buckets = self._manifest(known)["buckets"] if known else buckets

    # versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The newest version; 0 before the first."""
        fs, p = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def _manifest(self, version: int) -> dict:
        fs, p = self._fs(f"{self.path}/versions/{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether this writer has made the version: by a link or a rename that never replaces a file."""
        text = json.dumps(manifest).encode()
        final, draft = f"{self.path}/versions/{version:08d}.json", f"{self.path}/versions/.{uuid.uuid4().hex}"
        fs, target = self._fs(final)
        fs.mkdirs(target.getParent())
        if fs.getUri().getScheme() == "file":
            local, place = urlparse(draft).path, urlparse(final).path
            with open(local, "wb") as out:
                out.write(text)
            try:
                os.link(local, place)
            except FileExistsError:
                return False
            finally:
                os.unlink(local)
            return True
        _, source = self._fs(draft)
        out = fs.create(source, False)
        out.write(bytearray(text))
        out.close()
        done = not fs.exists(target) and fs.rename(source, target)
        if not done:
            fs.delete(source, False)
        return done

    # rows

    def _bucket(self):
        return F.pmod(F.hash(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None, since: int = 0) -> DataFrame | None:
        """The rows of a version, of some buckets only, or only those in folders that an earlier version lacks; None before the first version."""
        version = self.version() if version is None else version
        if not version:
            return None
        held = self._manifest(version)
        old = self._manifest(since)["folders"] if since else {}
        wanted = held["folders"] if buckets is None else {str(b): held["folders"].get(str(b), []) for b in buckets}
        paths = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, folders in wanted.items() for f in folders if f not in old.get(b, [])]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _store(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows into a new folder, a subfolder a bucket; its name and the buckets."""
        name = uuid.uuid4().hex
        place = f"{self.path}/data/{name}"
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(place)
        fs, p = self._fs(place)
        return name, sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith(BUCKET))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows' keys."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most `buckets` numbers

    def _stored(self, name: str, buckets: list[int], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{name}/{BUCKET}={b}" for b in buckets))

    def _drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/data/{name}")
        fs.delete(p, True)

    def add_missing(self, rows: DataFrame) -> int:
        """Adds rows whose key the table lacks, one for each key, and returns the version that has them. Adding them again changes nothing.

        rows are computed once, into a new folder; keys that the same buckets have already, or that another writer publishes
        meanwhile, are then left out of it.
        """
        schema, seen, version = rows.schema, 0, 0
        name, there = self._store(rows.dropDuplicates(self.key))
        while there:
            version = self.version()
            known = self.read(version, there, seen) if version else None
            mine = self._stored(name, there, schema)
            if known is not None:
                old = known.select(*(F.col(k).alias(f"_{k}") for k in self.key))
                same = [mine[k].eqNullSafe(old[f"_{k}"]) for k in self.key]
                if not mine.join(old, same, "left_semi").isEmpty():
                    first, (name, there) = name, self._store(mine.join(old, same, "left_anti"))
                    self._drop(first)
                    if not there:
                        break
            base = self._manifest(version) if version else {"buckets": self.buckets, "schema": schema.jsonValue(), "folders": {}}
            folders = base["folders"] | {str(b): [*base["folders"].get(str(b), []), name] for b in there}
            if self._publish(version + 1, base | {"folders": folders}):
                return version + 1
            seen = version
        self._drop(name)
        return version or self.version()

    def write_back(self, new: DataFrame, columns: list[str]) -> int:
        """Sets columns where new has the key, from its row; keys that the table lacks are ignored. Returns the new version.

        Only the buckets of new's keys are rewritten, into a new folder; the others keep their files. new has one row for each key.
        """
        side = new.select(*(F.col(k).alias(f"_{k}") for k in self.key), F.struct(*columns).alias("_new"))
        buckets = self.touched(new)
        while True:
            version = self.version()
            if not version or not buckets:
                return version
            rows = self.read(version, buckets)
            met = rows.join(side, [rows[k].eqNullSafe(side[f"_{k}"]) for k in self.key], "left")
            name, there = self._store(met.select(*((F.coalesce(f"_new.{c}", c) if c in columns else F.col(c)).alias(c) for c in rows.columns)))
            base = self._manifest(version)
            folders = {b: f for b, f in base["folders"].items() if int(b) not in buckets} | {str(b): [name] for b in there}
            if self._publish(version + 1, base | {"folders": folders}):
                return version + 1


def cached(df: DataFrame, compute, path: str, key: list[str], code: str, mode: str = "", buckets: int = 64) -> DataFrame:
    """compute's rows for every key of df: from the cache where they are there, else computed in one pass and published.

    An entry belongs to its key, which holds the content's hash, and to `code` and `mode`, the version and way in which compute works, and
    to the columns that it gives: another version, mode or schema misses. Of two writers that compute the same entry one is kept. Entries are read
    bucket by bucket of df's keys.
    """
    spark = df.sparkSession
    asked = df.dropDuplicates(key)
    schema = compute(asked.limit(0)).schema
    scope = F.lit(f"{code}_{mode}_{schema.simpleString()}")
    table = KeyedTable(spark, path, ["_entry"], buckets)
    entry = F.sha2(F.concat_ws("\x1f", scope, *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key)), 256)
    asked = asked.withColumn("_entry", entry)
    stored = F.to_json(F.struct(*schema.fieldNames()), {"ignoreNullFields": "false"})
    mine = table.touched(asked)
    known = table.read(buckets=mine)
    missing = asked if known is None else asked.join(known.select("_entry"), "_entry", "left_anti")
    table.add_missing(compute(missing.drop("_entry")).select(entry.alias("_entry"), stored.alias("_row")))
    got = table.read(buckets=mine)
    if got is None:
        return spark.createDataFrame([], schema)
    return got.join(asked.select("_entry"), "_entry", "left_semi").select(F.from_json("_row", schema).alias("r")).select("r.*")
