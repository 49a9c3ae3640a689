"""The driver's queries over the core operators. Every document is a file, ``source/lang/doc_id.txt``, of the UTF-8 bytes of its text."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.functions import codecs, container, digests, gf256, names
from octetflow.operators import archive, blocks, chunking, compare, delta, images, shares

#: A level of each codec, for the queries; the tests go through all.
LEVELS = [2, 8, 16]
N, K = 5, 3
#: Demonstration secrets: drawn once and given, as every caller must.
KEY, COEFFICIENTS, PASSWORD = bytes(range(32)), bytes(k * 7 & 255 for k in range(64)), "demonstration"
#: Bytes of an archive, give or take its last entry.
VOLUME = 64 << 20
#: Bytes of a block, and of a block for each share that is needed.
BLOCK = 4096


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, text = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    return docs.select("doc_id", folder.alias("folder"), _path(folder).alias("relative_path"), F.encode(text, "utf-8").alias("content"), F.octet_length(text).cast("long").alias("size"))


def _path(folder: Column) -> Column:
    return F.concat(folder, F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later version of the files: the folder src1 was renamed, and @ is spelled out, which changes some texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.coalesce("source", F.lit(""))
    folder = F.when(own == "src1", F.lit("src1-moved")).otherwise(own)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("@"), F.lit(" (at) "))
    return docs.select("doc_id", folder.alias("folder"), _path(folder).alias("relative_path"), F.encode(text, "utf-8").alias("content"), F.octet_length(text).cast("long").alias("size"))


def spread(df: DataFrame) -> DataFrame:
    """Byte work is dealt out by id where the scan has fewer tasks than there are cores, as with one small file; larger inputs stay where they are, without a shuffle."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition("doc_id") if few else df


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All digests in one pass over the bytes."""
    f = spread(files(spark, sf_dir))
    c = F.col("content")
    return f.select("doc_id", "relative_path", "size", digests.sha256(c).alias("sha256"), digests.crc32(c).alias("crc32"), digests.fnv(c).alias("fnv"))


def hash_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(files(spark, sf_dir)).select("doc_id", digests.hmac_sha256(F.col("content"), KEY).alias("hmac"))


def name_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with and without a trailing slash, numbers that are numbers throughout or none, and ratios of sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size, chars, source = F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.col("n_chars"), F.coalesce("source", F.lit(""))
    return docs.select(
        "doc_id", names.basename(F.concat(F.lit("/data/"), source, F.lit("/"))).alias("folder_name"), names.strict_int(F.substring(source, 4, 9)).alias("number"), names.strict_int(source).alias("no_number"),
        names.strict_int(F.concat(F.lit("-"), F.col("doc_id").cast("string"))).alias("negative"), F.round(names.ratio(size, chars), 9).alias("ratio"),
        F.round(names.reduction_percent(size, chars), 9).alias("reduction"), F.round(names.expansion_percent(chars, size), 9).alias("expansion"),
    )


def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", digests.sha256(F.col("content")).alias("sha256"))


def hash_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", digests.crc32(F.col("content")).alias("crc32"))


def hash_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(files(spark, sf_dir)).select("doc_id", digests.fnv(F.col("content")).alias("fnv"))


def hash_xxh3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(files(spark, sf_dir)).select("doc_id", digests.xxh3(F.col("content")).alias("xxh3"))


def hash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(files(spark, sf_dir)).select("doc_id", digests.blake2b(F.col("content")).alias("blake2b"), digests.hmac_sha256(F.col("content"), KEY).alias("hmac"))


def _listed(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    f = later(spark, sf_dir) if second else files(spark, sf_dir)
    return compare.listing(spread(f), ["folder"])


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir)


def folder_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.folder_digest(_listed(spark, sf_dir), ["folder"])


def folder_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(_listed(spark, sf_dir).drop("folder"), _listed(spark, sf_dir, True).drop("folder"))


def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summary(compare.compare(_listed(spark, sf_dir), _listed(spark, sf_dir, True), ["folder"]), ["folder"])


def folder_only_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.only_left(files(spark, sf_dir), later(spark, sf_dir), ["relative_path"])


def folder_only_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.only_right(files(spark, sf_dir), later(spark, sf_dir), ["relative_path"])


def folder_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.common(files(spark, sf_dir), later(spark, sf_dir), ["relative_path"])


def folder_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.same_folders(_listed(spark, sf_dir), _listed(spark, sf_dir, True), ["folder"])


def folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _listed(spark, sf_dir).drop("folder")
    return compare.report(listed, compare.folder_digest(listed), "documents")


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole = F.replace(F.concat(F.lit("C:\\site\\"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".v1.html")), F.lit("/"), F.lit("\\"))
    path = names.relative(whole, "C:\\site\\")
    return docs.select("page_id", path.alias("relative_path"), names.basename(path).alias("name"), names.stem(path).alias("stem"), names.extension(path).alias("extension"), names.zip_entry_kept(path).alias("kept"))


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    fields = F.create_map(F.lit("original_filename"), names.basename(F.col("relative_path")), F.lit("binary_length"), (F.col("size") * 8).cast("string"), F.lit("v"), F.lit("0.6"))
    back = names.from_json(names.to_json(fields))
    width = names.bit_width(names.strict_int(back["binary_length"]))
    return f.select("doc_id", back["original_filename"].alias("original_filename"), names.strict_int(back["binary_length"]).alias("binary_length"), width.cast("long").alias("bits"))


def archive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.layout(files(spark, sf_dir), ["folder"])


def archive_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive.pieces(files(spark, sf_dir), ["folder"])
    return out.select("folder", "offset", F.octet_length("piece").cast("long").alias("bytes"), F.sha2("piece", 256).alias("sha256"))


def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = archive.volumes(files(spark, sf_dir), ["folder"], VOLUME)
    back = archive.unpack(archive.pack(f, ["folder", "volume"]))
    return back.select("relative_path", F.col("data_size").alias("size"), F.sha2("data", 256).alias("sha256"))


def zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to ZIPs, those to archives, these to ZIPs again, and rows of them."""
    f = archive.volumes(files(spark, sf_dir), ["folder"], VOLUME)
    back = archive.zip_unpack(archive.archive_to_zip(archive.zip_to_archive(archive.zip_pack(f, ["folder", "volume"]))))
    return back.select("relative_path", F.col("data_size").alias("size"), F.sha2("data", 256).alias("sha256"))


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spread(files(spark, sf_dir).filter("size > 0"))  # there is nothing to compress in an empty file
    at_level = [f.select("doc_id", "size", F.lit(v).alias("level"), codecs.compressed(F.col("content"), v).alias("packed")) for v in LEVELS]
    out = at_level[0]
    for x in at_level[1:]:
        out = out.unionByName(x)
    return out


def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _compressed(spark, sf_dir)
    return out.select("doc_id", "level", codecs.detected(F.col("packed")).alias("format"), codecs.is_compressed(F.col("packed")).alias("is_compressed"))


def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _compressed(spark, sf_dir)
    return out.select("doc_id", "level", F.sha2(codecs.decompressed(F.col("packed")), 256).alias("sha256"))


def compress_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio and reduction of each level over all files."""
    out = _compressed(spark, sf_dir).groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("before"), F.sum(F.octet_length("packed")).alias("after"))
    before, after = F.col("before"), F.col("after")
    return out.select("level", "files", "before", "after", names.ratio(before, after).alias("ratio"), names.reduction_percent(before, after).alias("reduction_percent"))


def chunk_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(spread(files(spark, sf_dir)).select("doc_id", "content")).select("doc_id", "pos", F.col("len").cast("long").alias("len"), "level")


def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_index(chunking.chunk_rows(spread(files(spark, sf_dir)).select("doc_id", "content")))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return files(spark, sf_dir).select("doc_id", "content"), later(spark, sf_dir).select("doc_id", "content")


def diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.diff_ops(*_versions(spark, sf_dir), "doc_id")


def patch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _versions(spark, sf_dir)
    return delta.patch_sizes(delta.diff_ops(first, second, "doc_id"), second, "doc_id")


def patch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _versions(spark, sf_dir)
    back = delta.apply_patches(first, delta.make_patches(first, second, "doc_id"), "doc_id")
    return back.select("doc_id", F.sha2("content", 256).alias("sha256"))


def patch_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands as the stored patches name them."""
    first, second = _versions(spark, sf_dir)
    out = delta.patch_rows(delta.make_patches(first, second, "doc_id"), "doc_id")
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "op", "src_pos", "dst_pos", "len", F.sha2("payload", 256).alias("payload_sha256"))


def bmp_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    both = [f.select("doc_id", F.lit(g).alias("grey"), names.image_side(F.col("size"), g).alias("width")).withColumn("stride", names.image_stride(F.col("width"), g)) for g in (False, True)]
    return both[0].unionByName(both[1]).withColumn("pixel_bytes", F.col("stride") * F.col("width"))


def header_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    def size(names_, data):
        made = (container.header_for(d, n, False, False, False, with_hash=False, sha=True) for n, d in zip(names_.to_pylist(), data.to_pylist(), strict=True))
        return pa.array([len(h.to_bytes()) for h in made], pa.int64())

    f = spread(files(spark, sf_dir))
    return f.select("doc_id", F.arrow_udf(size, "long")(names.basename(F.col("relative_path")), "content").alias("header_bytes"))


def encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = digests.password_key(PASSWORD)
    f = spread(files(spark, sf_dir)).select("doc_id", "relative_path", "content")
    made = images.encode(f, "relative_path", level=8, key=key, sha=True, crc=True).drop("content")
    back = images.decode(made, key=key)
    return back.select("doc_id", "filename", F.sha2("content", 256).alias("sha256"), "hash_ok", "sha_ok", "crc_ok", "verified", "compressed")


def decode_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose first byte of payload was changed, and what decoding says of them."""
    f = spread(files(spark, sf_dir).filter("size > 0")).select("doc_id", "relative_path", "content")
    made = images.encode(f, "relative_path", sha=True, crc=True, grey=True)

    def damage(data):
        return pa.array([x[: (at := container.bmp_fields(x)["offset_data"])] + bytes([x[at] ^ 1]) + x[at + 1 :] for x in data.to_pylist()], pa.binary())

    back = images.decode(made.select("doc_id", F.arrow_udf(damage, "binary")("image").alias("image")))
    return back.select("doc_id", "hash_ok", "sha_ok", "crc_ok", "verified")


def block_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files that come in blocks, as those do that are too large for one value."""
    f = files(spark, sf_dir).select("relative_path", "content")
    return blocks.fnv(blocks.cut(f, BLOCK, "relative_path")).withColumnRenamed("path", "relative_path")


def block_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the payloads that dispersal makes block by block."""
    f = spread(files(spark, sf_dir)).select("relative_path", "content")
    size = BLOCK * K
    parts = blocks.disperse(blocks.cut(f, size, "relative_path"), N, K, KEY, KEY[:24], size)
    sums = parts.groupBy("path", "share_id").agg(F.sum(F.octet_length("bytes")).alias("payload_bytes"))
    return sums.select(F.col("path").alias("relative_path"), F.col("share_id").cast("long").alias("share_id"), "payload_bytes")


def gf256_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def times(a, b):
        return pa.array(gf256.MUL[a.to_numpy(), b.to_numpy()].astype("int64"))

    pairs = spark.range(1 << 16).select((F.col("id") / 256).cast("long").alias("a"), (F.col("id") % 256).alias("b"))
    return pairs.select("a", "b", F.arrow_udf(times, "long")("a", "b").alias("product"))


def share_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shares.share_sizes(files(spark, sf_dir), N, K, "doc_id")
    return out.select("doc_id", F.col("share_id").cast("long").alias("share_id"), "payload_bytes", "share_bytes", "storage_ratio", F.col("redundancy").cast("long").alias("redundancy"))


def integrate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the first n - k shares are enough."""
    f = spread(files(spark, sf_dir)).select(F.col("relative_path").alias("path"), "content")
    made = shares.split_files(f, N, K, KEY, COEFFICIENTS)
    back = shares.integrate_files(made.filter(F.col("share_id") > N - K))
    return back.select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("sha256"))


def shares_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spread(files(spark, sf_dir)).select(F.col("relative_path").alias("path"), "content")
    return shares.consistent(shares.split_files(f, N, K, KEY, COEFFICIENTS)).withColumnRenamed("path", "relative_path")


_ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    file_digests, hash_sha256, hash_crc32, hash_fnv1a, hash_xxh3, hash_blake2b, folder_listing, folder_digest, folder_compare, folder_summary, folder_only_left, folder_only_right,
    folder_common, folder_identical, folder_report, path_names, metadata_json, archive_layout, archive_pieces, pack_roundtrip, zip_roundtrip, format_detect, compress_roundtrip,
    hash_hmac, name_numbers, compress_stats, chunk_cuts, chunk_dedup, diff_ops, patch_size, patch_roundtrip, patch_commands, bmp_geometry, header_size, encode_roundtrip, decode_damaged, block_fnv, block_shares, gf256_table,
    share_sizes, integrate_roundtrip, shares_agree,
]
QUERIES = {f.__name__: f for f in _ALL}
