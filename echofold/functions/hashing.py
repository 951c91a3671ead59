"""Perceptual hashes and their distances as columns.

Two bit orders are in use, and each has its own packer here: a frame hash counts
its bits from the least significant (bit ``row * 8 + column``), an image hash
from the most significant (bit ``y * 16 + x``).  A bit is set where a pixel is
strictly brighter than its right neighbour.

A frame hash is a BIGINT of the same 64 bits, an audio sub-fingerprint a BIGINT
in [0, 2^32), an image hash 64 lower-case hex digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import GRAY_LEN, HASH_BYTES, HASH_SIZE, NUM_CHUNKS, ROW_STRIDE, SAMPLE_BYTES, SAMPLE_H, SAMPLE_W

_LOW32 = 4294967295


def _brighter(gray: Column, at: Column) -> Column:
    """Whether the pixel at a 0-based place is brighter than the next: single bytes of a BINARY compare unsigned."""
    return F.substring(gray, at + 1, F.lit(1)) > F.substring(gray, at + 2, F.lit(1))


def dhash_9x8(gray: Column | str) -> Column:
    """64-bit hash of a gray frame of 72 bytes. Null stays null; any other length is an error."""
    gray = F.col(gray) if isinstance(gray, str) else gray
    cell = lambda p: F.floor(p / (SAMPLE_W - 1)) * SAMPLE_W + p % (SAMPLE_W - 1)
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit((SAMPLE_W - 1) * SAMPLE_H - 1)),
        F.lit(0).cast("long"),
        lambda acc, p: F.when(_brighter(gray, cell(p).cast("int")), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p))).otherwise(acc),
    )
    wrong = F.raise_error(F.concat(F.lit(f"a gray frame has {SAMPLE_BYTES} bytes, not "), F.octet_length(gray).cast("string"))).cast("long")
    return F.when(F.octet_length(gray) == SAMPLE_BYTES, bits).when(gray.isNotNull(), wrong)


def _frame_bits(s: pd.Series, size: int, rows: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are not null, [row, y, x] bits)."""
    some = s.notna().to_numpy()
    data = s[some]
    bad = data.map(len) != size
    if bad.any():
        raise ValueError(f"a gray frame has {size} bytes, not {len(data[bad].iloc[0])}")
    pixels = np.frombuffer(b"".join(map(bytes, data)), np.uint8).reshape(-1, rows, stride)
    return some, pixels[:, :, :-1] > pixels[:, :, 1:]


@F.pandas_udf(T.LongType())
def dhash_9x8_arrow(gray: pd.Series) -> pd.Series:
    """As dhash_9x8, in numpy: for bulk."""
    some, bits = _frame_bits(gray, SAMPLE_BYTES, SAMPLE_H, SAMPLE_W)
    out = pd.array([None] * len(gray), "Int64")
    out[some] = np.packbits(bits.reshape(len(bits), -1), axis=1, bitorder="little").view("<i8")[:, 0]
    return pd.Series(out)


def image_hash_hex(gray: Column | str) -> Column:
    """256-bit hash of a gray image of 272 bytes, as 64 hex digits. Null for null and for any other length."""
    gray = F.col(gray) if isinstance(gray, str) else gray

    def digit(n: Column) -> Column:
        first = (F.floor(n / 4) * ROW_STRIDE + n % 4 * 4).cast("int")
        value = sum(F.when(_brighter(gray, first + k), 8 >> k).otherwise(0) for k in range(4))
        return F.substring(F.lit("0123456789abcdef"), value + 1, F.lit(1))

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(HASH_BYTES * 2 - 1)), digit), "")
    return F.when(F.octet_length(gray) == GRAY_LEN, whole)


@F.pandas_udf(T.StringType())
def image_hash_hex_arrow(gray: pd.Series) -> pd.Series:
    """As image_hash_hex, in numpy: for bulk. Any other length is an error."""
    some, bits = _frame_bits(gray, GRAY_LEN, HASH_SIZE, ROW_STRIDE)
    out = np.full(len(gray), None, object)
    out[some] = [r.tobytes().hex() for r in np.packbits(bits.reshape(len(bits), -1), axis=1)]
    return pd.Series(out)


def image_hash_error(gray: Column | str) -> Column:
    """Why a gray image has no hash; null if it has one."""
    gray = F.col(gray) if isinstance(gray, str) else gray
    got = F.octet_length(gray).cast("string")
    return F.when(F.octet_length(gray) != GRAY_LEN, F.concat(F.lit(f"wrong length: expected {GRAY_LEN}, got "), got))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming32(a: Column, b: Column) -> Column:
    """Of two values held as BIGINT; bits above the low 32 do not count."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_LOW32)))


def image_words(hex_hash: Column) -> Column:
    """array<bigint> of the hash's four 64-bit words, for comparing."""
    return F.array(*(F.conv(F.substring(hex_hash, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)))


def image_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two image hashes given as hex."""
    word = lambda h, k: F.conv(F.substring(h, 16 * k + 1, 16), 16, -10).cast("long")
    return sum(F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(4))


def chunk(hex_hash: Column, i: int) -> Column:
    """The i-th of 16 chunks of 16 bits, as INT."""
    return F.conv(F.substring(hex_hash, 4 * i + 1, 4), 16, 10).cast("int")


def chunks(hex_hash: Column) -> Column:
    return F.array(*(chunk(hex_hash, i) for i in range(NUM_CHUNKS)))


def image_hash_from_hex(text: Column) -> Column:
    """struct<hash, error>: the canonical hash of a hex string, or what is wrong with it.

    The length is in bytes. A sign or other non-digit in a pair is bad hex."""
    n = F.octet_length(text)
    error = F.when(n != HASH_BYTES * 2, F.concat(F.lit(f"wrong length: expected {HASH_BYTES * 2}, got "), n.cast("string"))).when(~text.rlike("^[0-9a-fA-F]{64}$"), F.lit("invalid hex digit"))
    return F.struct(F.when(error.isNull(), F.lower(text)).alias("hash"), error.alias("error"))


def parse_fingerprint(output: Column) -> Column:
    """struct<fps array<bigint>, error> from the text output of a raw fingerprint: the last FINGERPRINT= line.

    Values are signed numbers; their low 32 bits are kept."""
    lines = F.filter(F.split(output, "\r?\n"), lambda x: x.startswith("FINGERPRINT="))
    last = F.substr(F.get(lines, F.size(lines) - 1), F.lit(len("FINGERPRINT=") + 1))
    parts = F.filter(F.transform(F.split(last, ","), lambda x: F.trim(x)), lambda x: x != "")
    bad = F.filter(parts, lambda x: x.try_cast("long").isNull() | ~x.rlike("^[+-]?[0-9]+$"))
    values = F.transform(parts, lambda x: x.try_cast("long").bitwiseAND(F.lit(_LOW32)))
    error = F.when(F.size(lines) == 0, F.lit("fpcalc produced no fingerprint")).when(F.size(bad) > 0, F.concat(F.lit("parse fingerprint '"), F.get(bad, F.lit(0)), F.lit("'")))
    return F.struct(F.when(error.isNull(), values).alias("fps"), error.alias("error"))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def register(spark: SparkSession) -> None:
    """The functions for SQL, as temporary functions of the session."""
    spark.udf.register("dhash_9x8", dhash_9x8_arrow)
    spark.udf.register("image_hash_hex", image_hash_hex_arrow)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hamming32(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count((a ^ b) & {_LOW32}L)")
    words = " + ".join(f"bit_count(CAST(conv(substr(a, {16 * k + 1}, 16), 16, -10) AS BIGINT) ^ CAST(conv(substr(b, {16 * k + 1}, 16), 16, -10) AS BIGINT))" for k in range(4))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION image_hamming(a STRING, b STRING) RETURNS INT RETURN {words}")
