"""The engine's public surface: a chunk store on disk, and what can be done with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.operators import chunking, families, store


class Engine:
    """Tables below ``root``, a folder that all executors share: ``store`` (chunks) and ``blobs`` (compressed files).

    Every ``compress`` appends to both; the store is read as it was before the call. A run's chunks are written before
    its blobs, so a run that fails between leaves unused chunks, never blobs without theirs.
    """

    def __init__(self, spark: SparkSession, root: str, size: int = store.CHUNK, block: int = store.BLOCK, **options) -> None:
        self.spark, self.root, self.size, self.block, self.options = spark, root.rstrip("/"), size, block, options

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/*") if there else self.spark.createDataFrame([], schema)

    def store(self) -> DataFrame:
        # A failed run may have been repeated: one row per address.
        return self._read("store", store.STORE).dropDuplicates(["guid"])

    def blobs(self) -> DataFrame:
        return self._read("blobs", "file_id long, block_idx int, blob binary, original_len long")

    def compress(self, files: DataFrame) -> None:
        """``files``: (file_id long, bytes binary)."""
        blobs, new = store.compress(files, self.store(), self.size, self.block, **self.options)
        run = uuid.uuid4().hex
        new.write.parquet(f"{self.root}/store/{run}")
        blobs.write.parquet(f"{self.root}/blobs/{run}")

    def decompress(self, ids: DataFrame | None = None) -> DataFrame:
        """(file_id, block_idx, bytes, ok) of all files, or of those in ``ids`` (file_id)."""
        blobs = self.blobs()
        return store.decompress(blobs if ids is None else blobs.join(ids, "file_id", "left_semi"), self.store())

    def get(self, file_id: int) -> bytes:
        """One whole file; ValueError if it isn't there or is damaged."""
        wanted = self.blobs().where(F.col("file_id") == file_id)
        rows = store.decompress(wanted, self.store()).orderBy("block_idx").collect()
        if not rows or not all(r.ok for r in rows):
            raise ValueError(f"file {file_id} is missing or damaged")
        return b"".join(bytes(r.bytes) for r in rows)

    def stats(self) -> DataFrame:
        """One row: files, blocks, bytes in and stored, chunks, buckets, dedup counts and the average error."""
        of_store = self.store().agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("chunk")), F.lit(0)).alias("chunk_bytes"), F.count_distinct("bucket_id").alias("buckets"))
        blobs = self.blobs()
        of_blobs = blobs.agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("blocks"), F.sum("original_len").alias("original_bytes"), F.sum(F.length("blob")).alias("blob_bytes"))
        return of_store.join(of_blobs).join(store.statistics(blobs, self.size))  # three rows of totals

    def packs(self) -> DataFrame:
        """The blobs as I- and P-frames by the family of their first chunk's address."""
        refs = store.references(self.blobs()).where("chunk_idx >= 0").select(F.struct("file_id", "block_idx").alias("file_id"), "bucket_id")
        named = families.minhash_families(refs.withColumn("file_id", F.to_json("file_id")))
        blobs = self.blobs().select(F.to_json(F.struct("file_id", "block_idx")).alias("file_id"), "blob")
        entries = blobs.join(named, "file_id", "left").withColumn("family", F.coalesce("family", F.concat(F.lit("exact:"), F.col("file_id"))))
        return families.frames(entries)

    def delete(self, ids: DataFrame) -> None:
        """Remove the files of ``ids`` (file_id). What stays is written anew and then takes the old runs' place; a journal
        makes that safe against a crash at any point: ``recover`` finishes it, or leaves everything as it was."""
        self.recover()
        old, run = self._names("blobs"), uuid.uuid4().hex
        self.blobs().join(ids, "file_id", "left_anti").write.parquet(f"{self.root}/work/{run}")
        out = self._fs().create(self._path(f"work/{run}.journal"), True)
        out.write(bytearray("\n".join([run, *old]).encode()))
        out.close()
        self._fs().rename(self._path(f"work/{run}.journal"), self._path("work/journal"))
        self._finish()

    def recover(self) -> bool:
        """Finish what the journal says; without one, drop what a broken ``delete`` has begun. True if there was one."""
        found = self._fs().exists(self._path("work/journal"))
        if found:
            self._finish()
        self._fs().delete(self._path("work"), True)
        return found

    def _finish(self) -> None:
        """Each step may have been done already."""
        fs, path = self._fs(), f"{self.root}/work/journal"
        run, *old = [r.value for r in self.spark.read.text(path).collect()]
        if fs.exists(self._path(f"work/{run}")):
            fs.rename(self._path(f"work/{run}"), self._path(f"blobs/{run}"))
        for name in old:
            fs.delete(self._path(f"blobs/{name}"), True)
        fs.delete(self._path("work/journal"), False)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def clear(self) -> int:
        """Remove everything; the number of bytes freed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        freed = fs.getContentSummary(path).getLength() if fs.exists(path) else 0
        fs.delete(path, True)
        return int(freed)


def ingest(spark: SparkSession, path: str, declared: DataFrame | None = None) -> DataFrame:
    """(path, length, bytes, sha256) of files below ``path``; ``declared`` (path, sha256, and length if it has one) drops
    those that differ."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = found.select("path", "length", F.col("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if declared is None:
        return rows
    return rows.join(declared, [c for c in ("path", "sha256", "length") if c in declared.columns], "left_semi")


def listing(spark: SparkSession, path: str, most: int = 64 << 20) -> DataFrame:
    """(path, length) of files of at most ``most`` bytes; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most).select("path", "length")


def report(files: DataFrame, size: int = store.CHUNK) -> DataFrame:
    return chunking.dedup_report(chunking.chunks(files, size), size)
