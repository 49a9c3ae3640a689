"""k-of-n shares of files: encrypted, dispersed over GF(256), authenticated."""

from __future__ import annotations

import hmac
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from octetflow.functions.batches import lengths, stretches
from octetflow.functions.chacha import xchacha20_many
from octetflow.functions.digests import mac_key, same
from octetflow.functions.gf256 import inverse, join_secret, powers, product, split_secret

# Fixed value: layout of a share's header.
_HEAD = "<BIQ24s32s32s"
FIELDS = ["share_id", "k", "orig_size", "nonce", "key_share", "hmac", "payload"]
_KIND = pa.struct([("share_id", pa.int32()), ("k", pa.int32()), ("orig_size", pa.int64()), ("nonce", pa.binary()), ("key_share", pa.binary()), ("hmac", pa.binary()), ("payload", pa.binary())])
SCHEMA = "struct<share_id:int,k:int,orig_size:bigint,nonce:binary,key_share:binary,hmac:binary,payload:binary>"


def _fields() -> list[StructField]:
    return list(StructType.fromDDL(SCHEMA.removeprefix("struct<").removesuffix(">")))


def check(n: int, k: int) -> None:
    if not 1 <= k <= n <= 255:
        raise ValueError("1 <= k <= n <= 255 is needed")


def payloads(items: list[bytes], n: int, k: int, key: bytes, nonces: list[bytes], counters: list[int] | None = None) -> list[list[bytes]]:
    """For each item the payloads of its n shares: ciphertext of the padded data, each k bytes of it made n bytes. All items go through one product. ``counters``: where in its file's
    key stream an item begins, in blocks of 64 bytes."""
    secret = xchacha20_many(key, nonces, [d + bytes(-len(d) % k) for d in items], counters)
    made = product(powers(list(range(1, n + 1)), k), np.frombuffer(b"".join(secret), np.uint8).reshape(-1, k).T)
    ends = np.cumsum([len(x) // k for x in secret]).tolist()
    return [[made[i, lo:hi].tobytes() for i in range(n)] for lo, hi in zip([0, *ends], ends, strict=False)]


def split_many(items: list[bytes], n: int, k: int, key: bytes, nonces: list[bytes], coefficients: bytes) -> list[list[dict]]:
    """Key, nonces and coefficients (32 * (k - 1) bytes) are given, drawn once by the caller: a retried task must make the same shares."""
    check(n, k)
    secrets, sealed = split_secret(key, n, k, coefficients), mac_key(key)
    out = []
    for d, nonce, parts in zip(items, nonces, payloads(items, n, k, key, nonces), strict=True):
        out.append([{"share_id": i + 1, "k": k, "orig_size": len(d), "nonce": nonce, "key_share": s, "hmac": hmac.digest(sealed, p, "sha256"), "payload": p} for i, (p, s) in enumerate(zip(parts, secrets, strict=True))])
    return out


def split(data: bytes, n: int, k: int, key: bytes, nonce: bytes, coefficients: bytes) -> list[dict]:
    return split_many([data], n, k, key, [nonce], coefficients)[0]


def _checked(shares: list[dict]) -> tuple[tuple[int, ...], bytes, list[dict]]:
    """Ids, key and the first k shares, verified."""
    if not shares:
        raise ValueError("there are no shares")
    k = shares[0]["k"]
    if not 1 <= k <= 255 or len(shares) < k:
        raise ValueError(f"{k} shares are needed, {len(shares)} are there")
    shares = shares[:k]
    if len({(s["k"], s["orig_size"], s["nonce"], len(s["payload"])) for s in shares}) != 1:
        raise ValueError("the shares are not of one file")
    ids = tuple(s["share_id"] for s in shares)
    key = join_secret([s["key_share"] for s in shares], list(ids))
    sealed = mac_key(key)
    for s in shares:
        if not same(hmac.digest(sealed, s["payload"], "sha256"), s["hmac"]):
            raise ValueError(f"share {s['share_id']} is damaged")
    if shares[0]["orig_size"] > k * len(shares[0]["payload"]):
        raise ValueError("the size named is more than the shares hold")
    return ids, key, shares


def integrate_many(groups: list[list[dict]]) -> list[bytes]:
    """The files from the first k shares of each group; more are ignored. Groups of the same ids and key go through one product."""
    alike: dict[tuple, list[tuple[int, list[dict]]]] = {}
    for i, g in enumerate(groups):
        ids, key, shares = _checked(g)
        alike.setdefault((ids, key), []).append((i, shares))
    out = [b""] * len(groups)
    for (ids, key), members in alike.items():
        stacked = np.array([np.frombuffer(b"".join(s[r]["payload"] for _, s in members), np.uint8) for r in range(len(ids))])
        plain = product(inverse(powers(list(ids), len(ids))), stacked).T.tobytes()
        cuts = np.cumsum([0] + [len(ids) * len(s[0]["payload"]) for _, s in members]).tolist()
        secret = [plain[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
        for (i, s), data in zip(members, xchacha20_many(key, [s[0]["nonce"] for _, s in members], secret), strict=True):
            out[i] = data[: s[0]["orig_size"]]
    return out


def integrate(shares: list[dict]) -> bytes:
    return integrate_many([shares])[0]


def write_share(s: dict) -> bytes:
    return struct.pack(_HEAD, s["share_id"], s["k"], s["orig_size"], s["nonce"], s["key_share"], s["hmac"]) + s["payload"]


def share_bytes() -> Column:
    """Stored form of the share in a row's columns."""
    run = F.arrow_udf(lambda s: pa.array([write_share(x) for x in s.to_pylist()], pa.binary()), "binary")
    return run(F.struct(*FIELDS))


def read_share(raw: bytes) -> dict:
    if len(raw) < struct.calcsize(_HEAD):
        raise ValueError("the share is cut short")
    return dict(zip(FIELDS, (*struct.unpack_from(_HEAD, raw), raw[struct.calcsize(_HEAD) :]), strict=True))


def split_files(files: DataFrame, n: int, k: int, key: bytes, coefficients: bytes, path: str = "path", content: str = "content", nonce: str | None = None) -> DataFrame:
    """(path, fields of a share), n rows a file. ``nonce``: a column of 24 bytes, one of its own for each file under one key; by default the first 24 bytes of the SHA-256 of path and content."""
    check(n, k)
    own = F.col(nonce) if nonce else F.substring(F.unhex(F.sha2(F.concat(F.encode(path, "utf-8"), F.lit(b"\0"), F.col(content)), 256)), 1, 24)

    def run(batches):
        for batch in batches:
            paths, data, nonces = batch.columns
            for lo, hi in stretches(lengths(data) * n // k + n * 512):  # a share has some hundred bytes beside its payload
                made = split_many(data.slice(lo, hi - lo).to_pylist(), n, k, key, nonces.slice(lo, hi - lo).to_pylist(), coefficients)
                fields = pa.array([s for parts in made for s in parts], _KIND).flatten()
                yield pa.RecordBatch.from_arrays([paths.take(pa.array(np.repeat(np.arange(lo, hi), n))), *fields], [path, *FIELDS])

    rows = files.select(path, F.col(content), own.alias("nonce"))
    return rows.mapInArrow(run, StructType([rows.schema[0], *_fields()]))


def integrate_files(shares: DataFrame, path: str = "path", order: str = "share_id") -> DataFrame:
    """(path, content) from the first k shares of each file by ``order``. Shares that do not agree, too few, or damaged ones fail."""

    def run(batches):
        for batch in batches:
            paths, sizes, groups = batch.columns
            for lo, hi in stretches(sizes.to_numpy() + 512):
                made = integrate_many([[s["s"] for s in sorted(g, key=lambda x: x["o"])] for g in groups.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([paths.slice(lo, hi - lo), pa.array(made, pa.binary())], [path, "content"])

    of = F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*FIELDS).alias("s")))  # 255 shares at most
    grouped = shares.groupBy(path).agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("size"), of.alias("g"))
    return grouped.mapInArrow(run, StructType([grouped.schema[0], StructField("content", BinaryType())]))


def consistent(shares: DataFrame, path: str = "path") -> DataFrame:
    """(path, agree): whether threshold, size and nonce are the same in all shares."""
    return shares.groupBy(path).agg((F.count_distinct("k", "orig_size", "nonce") == 1).alias("agree"))


def share_sizes(files: DataFrame, n: int, k: int, path: str = "path", content: str = "content") -> DataFrame:
    """(path, share_id, payload_bytes, share_bytes, storage_ratio, redundancy) without making shares."""
    size = F.ceil(F.octet_length(content) / F.lit(k)).cast("long")
    return files.select(path, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("share_id"), size.alias("payload_bytes"), (size + struct.calcsize(_HEAD)).alias("share_bytes"), F.lit(n / k).alias("storage_ratio"), F.lit(n - k).alias("redundancy"))
