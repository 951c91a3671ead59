"""Frames, clips, fingerprints and images made of the test tables, which hold no media.

Every view covers its whole table and whole texts.  Each is given for Spark and
as SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_hash(text: Column, digits: int = 15) -> Column:
    """A non-negative BIGINT of the first hex digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _pieces(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, gray): a text's UTF-8 bytes in pieces of a size, the last filled up with zero bytes."""
    data = F.col("text").cast("binary")
    n = F.ceil(F.octet_length("text") / size).cast("int")

    def piece(k: Column) -> Column:
        return F.rpad(F.substring(data, k * size + 1, F.lit(size)), F.lit(size), F.lit(b"\0"))

    # pieces are cut before they become rows: a row that still had its whole text would carry it into whatever buffers rows
    return df.where(F.octet_length("text") > 0).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), piece)).alias("pos", "gray"))


def byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(table(spark, sf_dir, "documents"), 72)


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, gray): idx is doc_id * 2^20 + number of the piece."""
    return _pieces(table(spark, sf_dir, "documents"), 272).select((F.col("doc_id") * 1048576 + F.col("pos")).alias("idx"), "gray")


def hashed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, hash)."""
    from ..functions import image_hash_hex_arrow

    return text_images(spark, sf_dir).select("idx", image_hash_hex_arrow("gray").alias("hash"))


def event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hashes): a user's events in order of time, each a hash of its type."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", md5_hash(F.col("event_type")).alias("h"))))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.transform(ordered, lambda x: x["h"]).alias("hashes"))


def event_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, fps): as event_clips, with 32 bits for each event."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", md5_hash(F.col("event_type"), 8).alias("h"))))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.transform(ordered, lambda x: x["h"]).alias("fps"))


def _split_clips(df: DataFrame, pattern: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", pattern), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.col("doc_id").alias("id"), F.transform(parts, lambda x: md5_hash(x)).alias("hashes"))


def sentence_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hashes): a document's sentences in order, each a hash of its text."""
    return _split_clips(table(spark, sf_dir, "documents"), r"[.\n]")


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, segments): a conversation's turns in order, each the hashes of its words."""
    parts = F.transform(F.filter(F.split("text", r"[ \n]"), lambda x: x != ""), lambda x: md5_hash(x))
    ordered = F.sort_array(F.collect_list(F.struct("turn", parts.alias("h"))))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(ordered, lambda x: x["h"]).alias("segments"))


def ranks(clips: DataFrame) -> DataFrame:
    """A rank for four of five ids."""
    return clips.where("id % 5 <> 0").select("id", (F.col("id") % 7).cast("decimal(20,0)").alias("rank"))


def excluded(clips: DataFrame) -> DataFrame:
    """Pairs of neighbouring ids, and of ids two apart stored the wrong way round, which has no effect."""
    near = clips.select(F.col("id").alias("id_lo"), (F.col("id") + 1).alias("id_hi"))
    return near.unionByName(clips.select((F.col("id") + 2).alias("id_lo"), F.col("id").alias("id_hi")))


#: The same views in DuckDB's SQL, as bodies of common table expressions.
SQL = {
    "event_frames": "SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, ('0x' || substr(md5(event_type), 1, 15))::BIGINT AS hash FROM events",
    "print_frames": "SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, ('0x' || substr(md5(event_type), 1, 8))::BIGINT AS hash FROM events",
    "sentence_frames": r"""SELECT id, pos - 1 AS pos, ('0x' || substr(md5(p), 1, 15))::BIGINT AS hash FROM (
      SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
        SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), x -> trim(x)), x -> x <> '') AS ps FROM documents))""",
    "segment_frames": r"""SELECT id, seg, pos - 1 AS pos, ('0x' || substr(md5(p), 1, 15))::BIGINT AS hash FROM (
      SELECT id, seg, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
        SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg, list_filter(regexp_split_to_array(text, '[ \n]'), x -> x <> '') AS ps FROM conversations))""",
    "byte_frames": "SELECT doc_id, pos::INT AS pos, rpad(substr(h, (pos * 144 + 1)::INT, 144), 144, '0') AS gray FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 143) // 144)) AS pos FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))",
    "text_images": "SELECT doc_id * 1048576 + pos AS idx, rpad(substr(h, (pos * 544 + 1)::INT, 544), 544, '0') AS gray FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 543) // 544)) AS pos FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))",
    "hashed_images": """SELECT idx, list_aggregate(list_transform(range(0, 64), lambda n: substr('0123456789abcdef', 1 +
        list_sum(list_transform(range(0, 4), lambda k: CASE WHEN substr(gray, (2 * (n // 4 * 17 + n % 4 * 4 + k) + 1)::INT, 2) > substr(gray, (2 * (n // 4 * 17 + n % 4 * 4 + k) + 3)::INT, 2) THEN (8 >> k::INT) ELSE 0 END))::INT, 1)), 'string_agg', '') AS hash
      FROM text_images""",
}
SQL["sentence_frames"] = SQL["sentence_frames"].replace("x ->", "lambda x:")
SQL["segment_frames"] = SQL["segment_frames"].replace("x ->", "lambda x:")
