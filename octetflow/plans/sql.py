"""The byte functions by name in SQL: ``register(spark)``, then ``SELECT octet_fnv(content) FROM files``."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from octetflow.functions import codecs, container, digests
from octetflow.operators import archive, chunking, delta

_ENTRIES = pa.list_(pa.struct([("relative_path", pa.string()), ("data", pa.binary())]))
_OPS = pa.list_(pa.struct([("op", pa.string()), ("src_pos", pa.int64()), ("dst_pos", pa.int64()), ("len", pa.int64()), ("payload", pa.binary())]))
_CHUNKS = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int64()), ("hash", pa.string()), ("level", pa.int32())]))


def _chunks(data: bytes) -> list[dict]:
    found = chunking.cuts(data)
    hashes = digests.word_fnv_many([data[p : p + n] for p, n, _ in found]).tolist()
    return [{"pos": p, "len": n, "hash": f"{h:016x}", "level": v} for (p, n, v), h in zip(found, hashes, strict=True)]


def _entries(read):
    return lambda data: [{"relative_path": p, "data": d} for p, d in read(data)]


def _ops(patch: bytes) -> list[dict]:
    return [dict(zip(("op", "src_pos", "dst_pos", "len", "payload"), o, strict=True)) for o in delta.read_patch(patch)[1]]


def _fields(image: bytes) -> list[tuple[str, str]] | None:
    head = container.bmp_header(image)
    return None if head is None else list(head.as_strings().items())


#: name: (function of values, number of arguments, SQL type, Arrow type). A null argument gives null.
FUNCTIONS = {
    "octet_xxh3": (lambda x: f"{xxhash.xxh3_64_intdigest(x):X}", 1, "string", pa.string()),
    "octet_blake2b": (lambda x: hashlib.blake2b(x, digest_size=32).hexdigest(), 1, "string", pa.string()),
    "octet_word_fnv": (lambda x: f"{digests.word_fnv(x):016x}", 1, "string", pa.string()),
    "octet_compress": (codecs.compress, 2, "binary", pa.binary()),
    "octet_decompress": (codecs.decompress, 1, "binary", pa.binary()),
    "octet_format": (codecs.detect, 1, "string", pa.string()),
    "octet_chunks": (_chunks, 1, "array<struct<pos:bigint,len:bigint,hash:string,level:int>>", _CHUNKS),
    "octet_unpack": (_entries(archive.unpack_entries), 1, "array<struct<relative_path:string,data:binary>>", _ENTRIES),
    "octet_unzip": (_entries(archive.zip_entries), 1, "array<struct<relative_path:string,data:binary>>", _ENTRIES),
    "octet_diff": (lambda a, b: delta.write_patch(b, delta.file_ops([(a, b)])[0]), 2, "binary", pa.binary()),
    "octet_patch": (delta.apply_patch, 2, "binary", pa.binary()),
    "octet_patch_ops": (_ops, 1, "array<struct<op:string,src_pos:bigint,dst_pos:bigint,len:bigint,payload:binary>>", _OPS),
    "octet_header": (_fields, 1, "map<string,string>", pa.map_(pa.string(), pa.string())),
    "octet_payload": (container.bmp_decode, 1, "binary", pa.binary()),
}
#: Those that work on a whole batch at once.
_MANY = {"octet_fnv": (lambda xs: [f"{h:016x}" for h in digests.fnv1a_many(xs).tolist()], "string", pa.string())}


def _each(f, arguments: int, kind):
    def one(x):
        return pa.array([None if v is None else f(v) for v in x.to_pylist()], kind)

    def two(x, y):
        return pa.array([None if a is None or b is None else f(a, b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], kind)

    return two if arguments == 2 else one


def _whole(f, kind):
    def run(x):
        values = x.to_pylist()
        found = iter(f([v for v in values if v is not None]))
        return pa.array([None if v is None else next(found) for v in values], kind)

    return run


def register(spark: SparkSession) -> list[str]:
    """Names of the functions registered."""
    for name, (f, arguments, sql, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.arrow_udf(_each(f, arguments, kind), sql))
    for name, (f, sql, kind) in _MANY.items():
        spark.udf.register(name, F.arrow_udf(_whole(f, kind), sql))
    return [*FUNCTIONS, *_MANY]
