import pytest
import zstandard
from pyspark.sql import functions as F

from octetflow.functions import codecs

TEXT = b"The quick brown fox jumps over the lazy dog. " * 50


@pytest.mark.parametrize("level", range(1, 22))
def test_levels(level):
    packed = codecs.compress(TEXT, level)
    assert codecs.detect(packed) == codecs.algorithm(level) and codecs.decompress(packed) == TEXT


@pytest.mark.parametrize("level", [0, 22, -1])
def test_levels_outside(level):
    with pytest.raises(ValueError):
        codecs.compress(TEXT, level)


def test_failures():
    with pytest.raises(ValueError):
        codecs.compress(b"", 3)
    for level in (2, 9, 17):
        with pytest.raises(Exception):  # noqa: B017
            codecs.decompress(codecs.compress(TEXT, level)[:-5])
    for bad in (b"", b"plain", b"\x28\xb5\x2f"):
        with pytest.raises(ValueError):
            codecs.decompress(bad)


def test_frames_one_after_another():
    frame = zstandard.ZstdCompressor().compress(TEXT)
    assert codecs.decompress(frame + frame) == TEXT + TEXT
    xz = codecs.compress(TEXT, 16)
    assert codecs.decompress(xz + xz) == TEXT + TEXT


def test_columns(spark):
    df = spark.createDataFrame([(TEXT,), (None,)], "c binary")
    for level, name in ((3, "LZ4 Frame"), (12, "ZSTD"), (20, "LZMA2/XZ")):
        packed = df.select(codecs.compressed(F.col("c"), level).alias("p"))
        rows = packed.select(codecs.detected(F.col("p")), codecs.is_compressed(F.col("p")), codecs.decompressed(F.col("p"))).collect()
        assert rows[0][0] == name and rows[0][1] and bytes(rows[0][2]) == TEXT and rows[1][2] is None
    assert df.select(codecs.detected(F.col("c"))).first()[0] == "Unknown"
