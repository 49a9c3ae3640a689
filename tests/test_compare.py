from pyspark.sql import functions as F

from octetflow.functions.digests import fnv1a
from octetflow.operators import compare as C


def by_hand(rows):
    lines = "".join(f"{p}:{h}:{s};" for p, h, s in sorted(rows, key=lambda r: r[0].encode()))
    return f"{fnv1a(lines.encode()):016x}"


def listed(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, hash string, size long")


def test_golden(spark):
    files = spark.createDataFrame([("a.txt", b"abc"), ("a/b", b"")], "relative_path string, content binary")
    out = C.folder_digest(C.listing(files)).first()
    assert tuple(out) == ("482abb24a9cee35d", 2, 3)
    lines = [r.value for r in C.report(C.listing(files), C.folder_digest(C.listing(files)), "x").collect()]
    assert lines == ["Folder: x", "Hash: 482abb24a9cee35d", "Total Files: 2", "", "a.txt", "  Hash: e71fa2190541574b", "  Size: 3 bytes", "", "a/b", "  Hash: cbf29ce484222325", "  Size: 0 bytes", ""]


def test_folder_over_many_tasks(spark):
    """One folder holds most rows, and reaches over several ranges."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", f"p/é{i:05d}", f"{i * 7919:016x}", i) for i in range(3000)] + [(f"f{i % 5}", f"x{i}", "00", i) for i in range(100)]
        df = spark.createDataFrame(rows, "folder string, relative_path string, hash string, size long").repartition(3)
        out = {r.folder: (r.folder_hash, r.files, r.bytes) for r in C.folder_digest(df, ["folder"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    names = {r[0] for r in rows}
    assert out == {n: (by_hand([r[1:] for r in rows if r[0] == n]), sum(r[0] == n for r in rows), sum(r[3] for r in rows if r[0] == n)) for n in names}


def test_nothing(spark):
    none = listed(spark, [])
    assert tuple(C.folder_digest(none).first()) == ("cbf29ce484222325", 0, 0)
    assert C.folder_digest(none.withColumn("folder", F.lit("a")), ["folder"]).count() == 0
    assert C.summary(C.compare(none, none)).first().are_identical is True


def test_nulls(spark):
    df = spark.createDataFrame([(None, "a", "0", 1), (None, None, "0", 1), ("g", "a", "0", 1)], "folder string, relative_path string, hash string, size long")
    out = {r.folder: r.files for r in C.folder_digest(df, ["folder"]).collect()}
    assert out == {None: 1, "g": 1}


def test_compare(spark):
    a = listed(spark, [("same", "1", 1), ("gone", "1", 1), ("hash", "1", 1), ("size", "1", 1)])
    b = listed(spark, [("same", "1", 1), ("new", "1", 1), ("hash", "2", 1), ("size", "1", 2)])
    out = C.compare(a, b)
    assert {r.relative_path: r.status for r in out.collect()} == {"same": "identical", "gone": "only_in_first", "new": "only_in_second", "hash": "modified", "size": "modified"}
    assert tuple(C.summary(out).first()) == (1, 1, 2, 1, False)
    paths = lambda df: sorted(r.relative_path for r in df.collect())
    assert paths(C.only_left(a, b, ["relative_path"])) == ["gone"] and paths(C.only_right(a, b, ["relative_path"])) == ["new"] and paths(C.common(a, b, ["relative_path"])) == ["hash", "same", "size"]
    both = [x.withColumn("f", F.lit("x")) for x in (a, b)]
    assert C.same_folders(both[0], both[1], ["f"]).first().are_identical is False and C.same_folders(both[0], both[0], ["f"]).first().are_identical is True


def test_the_report_digests_once(spark):
    files = spark.range(9).select(F.col("id").cast("string").alias("relative_path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    out = C.report(C.listing(files), C.folder_digest(C.listing(files)), "x")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [run(") == 2  # the digest of the folder, and the lines
    assert out.count() == 4 + 9 * 4
