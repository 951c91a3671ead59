import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold import functions as E

U64 = 2**64


def frame(f):
    return bytes(f(r, c) for r in range(8) for c in range(9))


FRAMES = [
    (frame(lambda r, c: 0), 0),
    (frame(lambda r, c: 128), 0),
    (frame(lambda r, c: 255), 0),
    (frame(lambda r, c: 200 - c), U64 - 1),
    (frame(lambda r, c: c), 0),
    (frame(lambda r, c: 9 if (r, c) == (0, 0) else 0), 1),
    (frame(lambda r, c: 20 - c if r == 0 else 0), 0xFF),
    (frame(lambda r, c: 20 - c if r == 1 else 0), 0xFF00),
    (frame(lambda r, c: 20 - c if r == 7 else 0), 0xFF00000000000000),
    (bytes(i * 11 % 256 for i in range(72)), 0x4000020000200000),
    (bytes((i * 13 + 7) % 256 for i in range(72)), 0x0010000400020000),
    (bytes(i * 13 % 256 for i in range(72)), 0x0020000800020000),
]


def gray_image(seed):
    return bytes(((seed + i) * 2654435761 >> 3) & 255 for i in range(272))


IMAGES = [
    (bytes(272), "0" * 64),
    (bytes(255 - x for _ in range(16) for x in range(17)), "f" * 64),
    (bytes(i * 7 % 256 for i in range(272)), "0000000020000000040000000100000000200000000800000001000000008000"),
    (gray_image(7), "2110084442111088842221080844421110848421210808424210108484212108"),
]


@pytest.mark.parametrize("form", [E.dhash_9x8, E.dhash_9x8_arrow])
def test_frame_hash(spark, form):
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(FRAMES)] + [(99, None)], "i int, g binary")
    got = {r.i: r.h for r in df.select("i", form(F.col("g")).alias("h")).collect()}
    assert got.pop(99) is None
    assert {i: h % U64 for i, h in got.items()} == {i: h for i, (_, h) in enumerate(FRAMES)}


@pytest.mark.parametrize("form", [E.dhash_9x8, E.dhash_9x8_arrow])
def test_frame_length(spark, form):
    with pytest.raises(Exception, match="72 bytes"):
        spark.createDataFrame([(b"abc",)], "g binary").select(form(F.col("g"))).collect()


def test_image_hash(spark):
    df = spark.createDataFrame([(g,) for g, _ in IMAGES], "g binary")
    rows = df.select(E.image_hash_hex("g").alias("a"), E.image_hash_hex_arrow("g").alias("b"), E.image_hash_error("g").alias("e")).collect()
    assert [(r.a, r.b, r.e) for r in rows] == [(h, h, None) for _, h in IMAGES]
    r = spark.createDataFrame([(b"abc",), (None,)], "g binary").select(E.image_hash_hex("g").alias("h"), E.image_hash_error("g").alias("e")).collect()
    assert [tuple(x) for x in r] == [(None, "wrong length: expected 272, got 3"), (None, None)]


def test_distances(spark):
    df = spark.createDataFrame([(0, -1), (5, 5), (1 << 62, 0)], "a long, b long")
    assert [r[0] for r in df.select(E.hamming64(F.col("a"), F.col("b"))).collect()] == [64, 0, 1]
    df = spark.createDataFrame([(0, 2**32 - 1), (7, 0)], "a long, b long")
    assert [r[0] for r in df.select(E.hamming32(F.col("a"), F.col("b"))).collect()] == [32, 3]
    a, b = IMAGES[3][1], spark.createDataFrame([(gray_image(200),)], "g binary").select(E.image_hash_hex("g")).first()[0]
    both = spark.createDataFrame([(a, b), ("0" * 64, "f" * 64)], "a string, b string")
    assert [r[0] for r in both.select(E.image_hamming(F.col("a"), F.col("b"))).collect()] == [100, 256]


def test_random_against_numpy(spark):
    rng = np.random.default_rng(1)
    frames, images = rng.integers(0, 4, (40, 72), np.uint8), rng.integers(0, 256, (40, 272), np.uint8)
    df = spark.createDataFrame([(f.tobytes(), g.tobytes()) for f, g in zip(frames, images, strict=True)], "f binary, g binary")
    for f, g, r in zip(frames, images, df.select(E.dhash_9x8("f").alias("f"), E.dhash_9x8_arrow("f").alias("f2"), E.image_hash_hex("g").alias("g"), E.image_hash_hex_arrow("g").alias("g2")).collect(), strict=True):
        grid, own = f.reshape(8, 9), 0
        for y in range(8):
            for x in range(8):
                own |= int(grid[y, x] > grid[y, x + 1]) << y * 8 + x
        assert r.f % U64 == r.f2 % U64 == own
        grid, bits = g.reshape(16, 17), ""
        for y in range(16):
            for x in range(16):
                bits += "01"[int(grid[y, x] > grid[y, x + 1])]
        assert r.g == r.g2 == f"{int(bits, 2):064x}"


def test_hex(spark):
    texts = ["F" * 64, "0g" + "0" * 62, "0" * 63, "+f" + "0" * 62, "é" * 32, None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.image_hash_from_hex(F.col("t"))).collect()]
    bad = (None, "invalid hex digit")
    assert got == [("f" * 64, None), bad, (None, "wrong length: expected 64, got 63"), bad, bad, (None, None)]
    h = "".join(f"{i:04x}" for i in range(16))
    r = spark.createDataFrame([(h,)], "h string").select(E.chunks(F.col("h")), E.chunk(F.col("h"), 3), E.image_words(F.col("h"))).first()
    assert list(r[0]) == list(range(16)) and r[1] == 3 and r[2][0] == 0x0000000100020003


def test_fingerprint_output(spark):
    texts = ["FINGERPRINT=1,-1, 4294967296 ,,7\n", "x\nFINGERPRINT=9\nFINGERPRINT=", "nothing", "FINGERPRINT=1,x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.parse_fingerprint(F.col("t"))).collect()]
    assert got[0].fps == [1, 2**32 - 1, 0, 7] and got[1].fps == []
    assert (got[2].fps, got[2].error) == (None, "fpcalc produced no fingerprint")
    assert (got[3].fps, got[3].error) == (None, "parse fingerprint 'x'")


def test_sql_functions(spark):
    E.register(spark)
    r = spark.sql("SELECT hamming64(0, -1), hamming32(0, 4294967295), image_hamming(repeat('0', 64), repeat('f', 64))").first()
    assert tuple(r) == (64, 32, 256)


def test_sha256(spark):
    r = spark.createDataFrame([("",), ("abc",)], "t string").select(E.sha256_hex(F.col("t"))).collect()
    assert [x[0] for x in r] == [hashlib.sha256(t).hexdigest() for t in (b"", b"abc")]
