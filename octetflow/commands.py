"""The operators as commands on files: ``python -m octetflow hash FOLDER``."""

from __future__ import annotations

import argparse
import os
import secrets
import sys
import time

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.functions import codecs, digests, names
from octetflow.operators import archive, blocks, compare, delta, images, shares
from octetflow.sources import files as store

VERSION = "0.6"
#: Files above this many bytes are read by blocks where the command has a way for it; others are one value.
LARGE = 1 << 30
#: Names of digests as they are shown.
_SHOWN = {"sha": ("SHA-256", digests.sha256), "crc": ("CRC32", digests.crc32), "xxh": ("xxHash64", digests.xxh3)}


def _whole(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(_whole(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(_whole(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def _one(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of one file."""
    if _is_folder(spark, path):
        raise ValueError(f"{path} is a folder")
    return spark.read.format("binaryFile").load(_whole(path)).select(F.lit(_name(path)).alias("path"), "content")


def _save(df: DataFrame, folder: str) -> None:
    """(relative_path, content) as files of a folder."""
    df.select("relative_path", "content").write.format("octet_files").mode("append").save(_whole(folder))


def _named(df: DataFrame, content: str, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("relative_path"), F.col(content).alias("content"))


def hash_(spark: SparkSession, a: argparse.Namespace) -> None:
    if _is_folder(spark, a.path):
        listed = compare.listing(store.scan(spark, _whole(a.path), not a.no_recursion).repartition("relative_path"))
        digest = compare.folder_digest(listed)
        print(f"Folder Hash: {digest.first()['folder_hash']}")
        if a.export_info:
            compare.report(listed, digest, a.path).write.text(_whole(f"{a.save_path}/{_name(a.path)}_hash_info.txt"))
        return
    wanted = [k for k in ("sha", "crc") if getattr(a, k)] or ["xxh"]
    if _size(spark, a.path) > LARGE:
        row = blocks.digests(spark.read.format("octet_blocks").load(_whole(a.path))).first()
        for k in wanted:
            print(f"{_SHOWN[k][0]}: {row[k]}")
        return
    row = _one(spark, a.path).select(*(_SHOWN[k][1](F.col("content")).alias(k) for k in wanted)).first()
    for k in wanted:
        print(f"{_SHOWN[k][0]}: {row[k]}")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    if not _is_folder(spark, folder):
        raise ValueError(f"{folder} is no folder")
    return store.scan(spark, _whole(folder)).select("relative_path", "content")


def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    out = f"{a.save_path}/{a.output or _name(a.path) + '.cfup'}"
    archive.pieces(_packed(spark, a.path)).write.format("octet_archive").mode("append").save(_whole(out))


def unpack(spark: SparkSession, a: argparse.Namespace) -> None:
    entries = archive.unpack(_one(spark, a.path).withColumnRenamed("content", "archive"))
    _save(entries.select("relative_path", F.col("data").alias("content")), f"{a.save_path}/{a.output or os.path.splitext(_name(a.path))[0]}")


def ztc(spark: SparkSession, a: argparse.Namespace) -> None:
    made = archive.zip_to_archive(_one(spark, a.path).withColumnRenamed("content", "archive"))
    _save(_named(made, "archive", a.output or os.path.splitext(_name(a.path))[0] + ".cfup"), a.save_path)


def _statistics(spark: SparkSession, source: str, target: str, seconds: float, percent, shown: str) -> None:
    """Sizes, their ratio, what was saved or added, and MiB a second, from the two files' sizes."""
    sizes = spark.createDataFrame([(_size(spark, source), _size(spark, target), seconds)], "a long, b long, s double")
    larger = "b" if shown == "Expansion" else "a"
    smaller = "a" if larger == "b" else "b"
    row = sizes.select("a", "b", names.ratio(F.col(larger), F.col(smaller)).alias("ratio"), percent(F.col("a"), F.col("b")).alias("percent"), names.throughput_mib(F.col(larger), F.col("s")).alias("speed")).first()
    print(f"{row['a']} -> {row['b']} bytes, ratio {row['ratio'] or 0:.2f}, {shown} {row['percent'] or 0:.2f}%, {row['speed'] or 0:.2f} MiB/s")


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    began, name = time.monotonic(), a.output or os.path.splitext(_name(a.path))[0] + ".cfmp"
    _save(_named(_one(spark, a.path).withColumn("content", codecs.compressed(F.col("content"), a.level)), "content", name), a.save_path)
    _statistics(spark, a.path, f"{a.save_path}/{name}", time.monotonic() - began, names.reduction_percent, "Reduction")


def decompress(spark: SparkSession, a: argparse.Namespace) -> None:
    began, name = time.monotonic(), a.output or os.path.splitext(_name(a.path))[0]
    _save(_named(_one(spark, a.path).withColumn("content", codecs.decompressed(F.col("content"))), "content", name), a.save_path)
    _statistics(spark, a.path, f"{a.save_path}/{name}", time.monotonic() - began, names.expansion_percent, "Expansion")


def diff(spark: SparkSession, a: argparse.Namespace) -> None:
    both = [_one(spark, p).withColumn("path", F.lit("")) for p in (a.source, a.target)]
    _save(_named(delta.make_patches(*both), "patch", a.output), a.save_path)


def patch(spark: SparkSession, a: argparse.Namespace) -> None:
    source, stored = (_one(spark, p).withColumn("path", F.lit("")) for p in (a.source, a.patch))
    _save(_named(delta.apply_patches(source, stored.withColumnRenamed("content", "patch")), "content", a.output), a.save_path)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    shares.check(a.n, a.k)
    key, nonce, coefficients = secrets.token_bytes(32), secrets.token_bytes(24), secrets.token_bytes(32 * (a.k - 1))  # drawn once, here
    made = shares.split_files(_one(spark, a.path).withColumn("nonce", F.lit(nonce)), a.n, a.k, key, coefficients, nonce="nonce")
    name = F.concat(F.lit(os.path.splitext(_name(a.path))[0] + "_split_"), F.col("share_id").cast("string"), F.lit(".cfs"))
    _save(made.select(name.alias("relative_path"), shares.share_bytes().alias("content")), a.save_path)
    print(f"{a.n} shares, any {a.k} recover; stored {a.n / a.k:.2f} times the input")


def integrate(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [store.read_shares(spark, _whole(p)).withColumn("n", F.lit(i)).withColumn("path", F.lit("")) for i, p in enumerate(a.shares)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    _save(_named(shares.integrate_files(whole, order="n"), "content", a.output), a.save_path)


def _password(a: argparse.Namespace) -> bytes:
    if not a.password_file:
        raise ValueError("an encrypted image needs --password-file")
    with open(a.password_file, "rb") as f:
        return digests.password_key(f.read().rstrip(b"\r\n"))


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    folder = _is_folder(spark, a.path)
    one = archive.pack(_packed(spark, a.path).withColumn("path", F.lit(_name(a.path) + ".cfup")), ["path"]).withColumnRenamed("archive", "content") if folder else _one(spark, a.path)
    if a.compress:
        one = one.withColumn("path", F.concat("path", F.lit(".cfmp")))
    key = None if a.no_encrypt else secrets.token_hex(32) if a.two_file else _password(a)
    made = images.encode(one, level=a.compress, key=key, grey=a.grayscale, packed=folder, with_hash=not a.skip_hash, sha=a.sha, crc=a.crc, two_file=a.two_file)
    stem = os.path.splitext(_name(a.path) + (".cfup" if folder else "") + (".cfmp" if a.compress else ""))[0]
    _save(_named(made, "image", stem + ".bmp"), a.save_path)
    if a.two_file:
        fields = F.map_concat("metadata", F.create_map(F.lit("encryption_key"), F.lit(key or "")))
        _save(made.select(F.lit(stem + ".mtd").alias("relative_path"), F.encode(F.to_json(fields), "utf-8").alias("content")), a.save_path)


def decode(spark: SparkSession, a: argparse.Namespace) -> None:
    image = _one(spark, a.path).withColumnRenamed("content", "image")
    beside, key, column = os.path.splitext(a.path)[0] + ".mtd", None, None
    if image.select(images.has_header(F.col("image"))).first()[0]:
        key = _password(a) if image.select(images.header_fields(F.col("image"))["encrypted"]).first()[0] == "true" else None
    else:
        fields = store.read_metadata(spark, _whole(beside)).first()["fields"]
        key = fields.pop("encryption_key", "") or None
        pairs = [F.lit(x) for kv in fields.items() for x in kv]
        image, column = image.withColumn("metadata", F.create_map(*pairs)), "metadata"
    out = images.decode(image, key=key, metadata=column)
    state = out.drop("content").first()
    if state["error"] or not state["accepted"]:
        raise ValueError(state["error"] or "the payload's digests don't agree with the stored ones")
    name = _name(state["filename"])
    if state["compressed"]:
        name = name.removesuffix(".cfmp")
    if state["packed"]:
        entries = images.unpacked(out)
        _save(entries.select("relative_path", F.col("data").alias("content")), f"{a.save_path}/{os.path.splitext(name)[0]}")
    else:
        _save(_named(out, "content", name), a.save_path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="octetflow", description="Binary content as data.")
    top.add_argument("--version", "-v", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)

    def add(run, about: str, *args: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__.rstrip("_"), help=about)
        for x in args:
            p.add_argument(x.rstrip("?"), **({"nargs": "?"} if x.endswith("?") else {}))
        p.add_argument("--save-path", "-sp", default=".")
        p.set_defaults(run=run)
        return p

    def flags(p: argparse.ArgumentParser, **names: list[str]) -> None:
        for dest, options in names.items():
            p.add_argument(*options, dest=dest, action="store_true")

    digest = {"sha": ["--sha", "--sha256"], "crc": ["--crc", "--crc32"]}
    flags(add(hash_, "digests of a file or folder", "path"), **digest, no_recursion=["--no-recursion", "-nr"], export_info=["--export-info", "-ei"])
    p = add(encode, "a file or folder into an image", "path")
    p.add_argument("--compress", "-c", type=int)
    p.add_argument("--password-file")
    flags(p, **digest, no_encrypt=["--no-encrypt", "-ne"], two_file=["--two-file", "-2f"], grayscale=["--grayscale", "-gs"], skip_hash=["--skip-hash", "-nh"])
    add(decode, "an image into its file or folder", "path").add_argument("--password-file")
    add(pack, "a folder into an archive", "path", "output?")
    add(unpack, "an archive into a folder", "path", "output?")
    add(ztc, "a ZIP into an archive", "path", "output?")
    p = add(compress, "compress a file, levels 1 to 21", "path")
    p.add_argument("level", type=int)
    p.add_argument("output", nargs="?")
    add(decompress, "decompress a file", "path", "output?")
    add(diff, "a patch from one file to another", "source", "target", "output")
    add(patch, "apply a patch", "source", "patch", "output")
    p = add(split, "n shares of which any k recover the file", "path")
    p.add_argument("-n", type=int, required=True)
    p.add_argument("-k", type=int, required=True)
    add(integrate, "a file from its shares", "output").add_argument("shares", nargs="+")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 after a message: no command leaves half of its output under its final name."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    store.register(spark)
    try:
        a.run(spark, a)
    except (ValueError, OSError, PySparkException, Py4JError) as e:
        lines = [x for x in str(e).splitlines() if x.strip()]
        print(f"{a.command}: {next((x for x in reversed(lines) if 'Error:' in x), lines[0] if lines else type(e).__name__)}", file=sys.stderr)
        return 1
    return 0
