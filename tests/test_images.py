import random

import pytest
from pyspark.sql import functions as F

from octetflow.functions import container as C
from octetflow.functions import names
from octetflow.functions.digests import password_key
from octetflow.operators import images
from octetflow.operators.archive import pack_entries

GOLDEN = (
    "484f4941010007000000190000000805000000000000000d0062696e6172795f6c656e677468102800000005000000080066696c656e616d6520010000002d0000000900656e6372797074656410180000002e0000000100762001000000460000000800636f6d7072657373"
    "20010000004700000004007061636b108000000048000000040068617368d8cc850e8f0e8c8b0d37384146354639343839324633393530"
)


def test_golden_header():
    h = C.header_for(b"abc", "f.txt", False, False, False)
    assert h.to_bytes().hex() == GOLDEN and h.size() == len(h.to_bytes()) == 163
    r = C.HeaderReader(h.to_bytes() + b"rest")
    assert (r.uint("binary_length"), r.string("filename"), r.boolean("pack"), r.string("hash"), r.length) == (24, "f.txt", False, "78AF5F94892F3950", 163)
    assert r.has("v") and not r.has("x") and r.uint("x") is None and r.string("pack") is None and r.uint("pack") == 0


def test_fields():
    w = C.HeaderWriter().uint("a", 5, C.UINT8, width=9).float("f", 1.5).double("d", -2.25).boolean("b", True).string("s", "é").uint("a", 2**64 - 1)
    r = C.HeaderReader(w.to_bytes())
    assert (r.uint("a"), r.float("f"), r.double("d"), r.boolean("b"), r.string("s")) == (2**64 - 1, 1.5, -2.25, True, "é")
    assert r.names() == ["a", "f", "d", "b", "s"] and w.entries[0][1] == 9
    w.clear()
    assert w.size() == 14
    for raw in (b"", b"\0" * 20, C.header_for(b"", "n", False, False, False).to_bytes()[:-1]):
        with pytest.raises(ValueError):
            C.HeaderReader(raw)
    with pytest.raises(ValueError):
        C.HeaderWriter().uint("a", -1)


@pytest.mark.parametrize("size,one,eight", [(0, (0, 0, 0), (0, 0, 0)), (3, (5, 4, 20), (2, 4, 8)), (1000, (90, 12, 1080), (32, 32, 1024))])
def test_geometry(size, one, eight):
    for grey, want in ((False, one), (True, eight)):
        w = C.side(size, grey)
        assert (w, C.stride(w, grey), w * C.stride(w, grey)) == want
        f = C.bmp_fields(C.bmp_encode(bytes(size), b"", None, grey))
        assert (f["width"], f["size_image"], f["offset_data"]) == (want[0], want[2], 1078 if grey else 62)


def test_geometry_columns(spark):
    sizes = [0, 1, 3, 999, 1000, 12345]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    for grey in (False, True):
        got = df.select("s", names.image_side(F.col("s"), grey).alias("w")).select("s", "w", names.image_stride(F.col("w"), grey).alias("t")).collect()
        assert all((r.w, r.t) == (C.side(r.s, grey), C.stride(C.side(r.s, grey), grey)) for r in got)


def contents():
    r = random.Random(4)
    return [(f"d/f{n}.txt", r.randbytes(n)) for n in (0, 1, 255, 1024, 5000)] + [("big", r.randbytes((1 << 20) + 7))]


@pytest.mark.parametrize("options", [{}, {"level": 9}, {"key": password_key("p"), "grey": True, "sha": True, "crc": True}, {"level": 2, "key": password_key("p"), "with_hash": False}, {"two_file": True, "key": "ab" * 32, "level": 8}])
def test_round_trip(spark, options):
    files = spark.createDataFrame(contents(), "path string, content binary")
    made = images.encode(files, **options)
    back = images.decode(made.drop("content"), key=options.get("key"), metadata="metadata" if options.get("two_file") else None)
    rows = {r.path: r for r in back.collect()}
    for path, data in contents():
        r = rows[path]
        assert r.error is None and bytes(r.content) == data and r.accepted and r.verified is (None if options.get('with_hash') is False and not (options.get('sha') or options.get('crc')) else True) and r.filename == path.rsplit("/", 1)[-1]
        assert r.compressed == bool(options.get("level")) and r.hash_ok is (None if options.get("with_hash") is False else True) and r.sha_ok is (True if options.get("sha") else None)


def test_damage_and_wrong_password(spark):
    files = spark.createDataFrame(contents()[2:], "path string, content binary")
    made = images.encode(files, key=password_key("p"), crc=True)
    assert not any(r.verified for r in images.decode(made.drop("content"), key=password_key("q")).collect())
    flip = images.encode(files).withColumn("image", F.expr("overlay(image placing X'5A5A5A' from 5000)"))
    rows = images.decode(flip.filter("path = 'big'").drop("content")).collect()
    assert [r.verified for r in rows] == [False] and rows[0].hash_ok is False
    broken = spark.createDataFrame([(b"",), (b"BM" + bytes(60),), (C.bmp_encode(b"abc"),), (C.bmp_encode(b"abc", C.header_for(b"abcd" * 99, "n", False, False, False).to_bytes()),)], "image binary")
    assert all(r.error and r.verified is False for r in images.decode(broken).collect())


def test_packed(spark):
    entries = [("a/b", b"x"), ("c", b"")]
    made = images.encode(spark.createDataFrame([("f.cfup", pack_entries(entries))], "path string, content binary"), level=8, packed=True)
    out = images.unpacked(images.decode(made.drop("content")))
    assert sorted((r.relative_path, bytes(r.data)) for r in out.collect()) == sorted(entries)


def test_verify():
    good = C.digest_texts(b"abc")
    assert C.verify(b"abc", good) == {"hash": True, "SHA": True, "CRC": True, "overall": True}
    assert C.verify(b"abc", {**good, "CRC": "0"})["overall"] is False
    assert C.verify(b"abc", {"hash": "", "SHA": "bad"}) == {"hash": None, "SHA": False, "CRC": None, "overall": True}


def test_nothing_stored_means_nothing_verified_and_a_missing_key_is_an_error(spark):
    rows = spark.createDataFrame([("a.txt", bytearray(b"some bytes " * 40))], "path string, content binary")
    hidden = images.encode(rows, key=password_key("p"), with_hash=False).drop("content")
    (none,) = images.decode(hidden).collect()
    assert "no key" in none.error and none.verified is False and none.accepted is False and none.content is None
    (wrong,) = images.decode(hidden, key=password_key("q")).collect()
    assert wrong.verified is None and wrong.accepted  # nothing stored can tell a wrong key
    (sha,) = images.decode(images.encode(rows, key=password_key("p"), with_hash=False, sha=True).drop("content"), key=password_key("q")).collect()
    assert sha.verified is False and sha.sha_ok is False and sha.accepted
    (plain,) = images.decode(images.encode(rows, with_hash=False).drop("content")).collect()
    assert plain.verified is None and bytes(plain.content) == b"some bytes " * 40
