"""SHA-256 of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sha256_hex


def hash_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, length, sha256) of files that Spark's binary reader can open; each file is one row, so below 2 GB.

    The reader leaves out files without content; they are added from its list of files."""
    files = spark.read.format("binaryFile").load(paths)
    read = files.select("path", "length", sha256_hex(F.col("content")).alias("sha256"))
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    listed = listed.withColumn("path", F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/"))
    empty = listed.join(read.select("path"), "path", "left_anti")
    return read.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), sha256_hex(F.lit(b"")).alias("sha256")))


def hash_large_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, sha256, error) of files of any size on a file system mounted on every executor, read in blocks of 64 KiB."""

    def run(batches):
        import hashlib

        for pdf in batches:
            digests, errors = [], []
            for p in pdf[path_col]:
                h = hashlib.sha256()
                try:
                    with open(p, "rb") as f:
                        while block := f.read(65536):
                            h.update(block)
                    digests.append(h.hexdigest())
                    errors.append(None)
                except OSError as e:
                    digests.append(None)
                    errors.append(str(e))
            yield pdf[[path_col]].assign(sha256=digests, error=errors)

    return paths.select(path_col).mapInPandas(run, f"`{path_col}` string, sha256 string, error string")
