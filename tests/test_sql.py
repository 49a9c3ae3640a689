from octetflow.functions import container
from octetflow.operators.archive import pack_entries
from octetflow.plans.sql import register


def test_functions_in_sql(spark):
    names = register(spark)
    assert len(names) == len(set(names)) == 15
    row = spark.sql("SELECT octet_fnv(X'616263'), octet_xxh3(X'616263'), octet_word_fnv(X'616263'), octet_fnv(CAST(NULL AS BINARY)), octet_format(octet_compress(X'616263', 9)), octet_decompress(octet_compress(X'616263', 3))").first()
    assert tuple(row) == ("e71fa2190541574b", "78AF5F94892F3950", "e71fa219e25ef552", None, "ZSTD", b"abc")
    assert spark.sql("SELECT octet_blake2b(encode('password', 'utf-8'))").first()[0] == "344b8a854221bd1eaf9382daaea1996fbcd496f158e983f8835c7ef5084c55bb"
    old, new = "repeat('the quick brown fox ', 200)", "concat('new ', repeat('the quick brown fox ', 200))"
    made = spark.sql(f"SELECT encode({old}, 'utf-8') a, encode({new}, 'utf-8') b").selectExpr("b", "octet_patch(a, octet_diff(a, b)) back", "size(octet_patch_ops(octet_diff(a, b))) n", "octet_chunks(a)[0].pos p").first()
    assert bytes(made.back) == bytes(made.b) and made.n >= 1 and made.p == 0
    image = container.bmp_encode(b"abc", container.header_for(b"abc", "f.txt", False, False, False).to_bytes())
    df = spark.createDataFrame([(pack_entries([("a/b", b"1")]), image)], "a binary, i binary")
    got = df.selectExpr("octet_unpack(a)[0].relative_path p", "octet_header(i)['filename'] f", "octet_payload(i) d").first()
    assert (got.p, got.f, bytes(got.d)) == ("a/b", "f.txt", b"abc")
