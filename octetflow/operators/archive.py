"""Archives: layout, packing, unpacking, and ZIP files in both directions."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from octetflow.functions import batches
from octetflow.functions.names import component_order
from octetflow.plans.scratch import written

_ROWS = "idx int, relative_path string, data_size long, data binary"


def layout(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, idx, relative_path, offset, data_size): where each entry starts, in component order of the paths. ``files``: (by, relative_path, size).

    Running sums in two steps, so that an archive of any number of entries is spread over tasks: rows are dealt by ranges of (by, path) and written; each
    range's sums give the ranges' starts, and windows run inside a range only."""
    by = by or []
    order = component_order(F.col("relative_path"))
    rows = files.select(*by, "relative_path", F.col("size").cast("long").alias("data_size"))
    ranged = written(rows.repartitionByRange(*by, order).withColumn("part", F.spark_partition_id()), "layout")
    cost = F.lit(12) + F.octet_length("relative_path") + F.col("data_size")
    sums = ranged.groupBy(*by, "part").agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select(*by, "part", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("cost0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*by, "part").orderBy(order)
    a, b = ranged.alias("a"), starts.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "part"]]
    joined = a.join(b, reduce(and_, same)).select(*(f"a.{c}" for c in [*by, "part", "relative_path", "data_size"]), "cost0", "n0")
    offset = F.lit(4) + F.col("cost0") + F.coalesce(F.sum(cost).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.select(*by, (F.col("n0") + F.row_number().over(inside) - 1).cast("long").alias("idx"), "relative_path", offset.cast("long").alias("offset"), "data_size")


def _distinct(placed: DataFrame, by: list[str]) -> DataFrame:
    """One row a path, as the layout has them; a path that stands twice in an archive fails the query, as its two rows could not be told apart."""
    said = F.concat(F.lit("the archive holds this path more than once: "), F.col("relative_path"))
    one = placed.groupBy(*by, "relative_path").agg(F.min("idx").alias("idx"), F.min("offset").alias("offset"), F.min("data_size").alias("data_size"), F.count("*").alias("rows"))
    return one.withColumn("offset", F.when(F.col("rows") > 1, F.raise_error(said).cast("long")).otherwise(F.col("offset"))).drop("rows")


def volumes(files: DataFrame, by: list[str], limit: int) -> DataFrame:
    """``files`` with a column ``volume``: successive stretches, in archive order, of about ``limit`` bytes, so that (by, volume) packs into archives of bounded size.
    Paths must be distinct in an archive; a repeated one is an error."""
    placed = _distinct(layout(files.select(*by, "relative_path", F.octet_length("content").alias("size")), by), by).select(*by, "relative_path", F.floor((F.col("offset") - 4) / F.lit(limit)).alias("volume"))
    f, p = files.alias("f"), placed.alias("p")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "relative_path"]]
    return f.join(p, reduce(and_, same)).select("f.*", "p.volume")


def pieces(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, offset, piece): bytes of archives and where they stand, an entry a row and one for the count. Written at their places, or joined in order, they are the
    archive; no task holds more than an entry, so archives can be of any size. ``files``: (by, relative_path, content), paths distinct in an archive; a repeated one is an error."""
    by = by or []
    placed = _distinct(layout(files.select(*by, "relative_path", F.octet_length("content").alias("size")), by), by)
    f, p = files.alias("f"), placed.alias("p")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "relative_path"]]
    head = F.concat(_little(F.octet_length(F.col("p.relative_path")).cast("long"), 4), F.encode(F.col("p.relative_path"), "utf-8"), _little(F.col("p.data_size"), 8))
    entries = f.join(p, reduce(and_, same)).select(*(f"p.{c}" for c in by), "p.offset", F.concat(head, F.col("f.content")).alias("piece"))
    counts = placed.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(0).cast("long").alias("offset"), _little(F.col("n"), 4).alias("piece"))
    return counts.unionByName(entries)


def _little(value: Column, width: int) -> Column:
    """A number as ``width`` little-endian bytes."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width)))))


class _Pack:
    """An archive that grows by an entry at a time, given in component order."""

    def __init__(self):
        self.out, self.n = bytearray(4), 0

    def add(self, path: str, data: bytes) -> None:
        raw = path.encode()
        self.out += struct.pack("<I", len(raw)) + raw + struct.pack("<Q", len(data))
        self.out += data
        self.n += 1

    def done(self) -> bytearray:
        self.out[:4] = struct.pack("<I", self.n)
        return self.out


class _Zip:
    """A ZIP that grows by an entry at a time. Deflate 6; the date is fixed, so that equal entries give equal bytes."""

    def __init__(self):
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=6)

    def add(self, path: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(posixpath.normpath(path)), data, zipfile.ZIP_DEFLATED, 6)

    def done(self) -> memoryview:
        self.zip.close()
        return self.out.getbuffer()


def _made(kind: type[_Pack] | type[_Zip], entries: Iterable[tuple[str, bytes]]) -> bytearray | memoryview:
    out = kind()
    for path, data in entries:
        out.add(path, data)
    return out.done()


def _components(path: str) -> list[bytes]:
    return [p.encode() for p in path.split("/")]


def pack_entries(entries: list[tuple[str, bytes]]) -> bytes:
    """Count, then for each entry path length, path, size and bytes; component order."""
    return bytes(_made(_Pack, sorted(entries, key=lambda e: _components(e[0]))))


def safe_path(path: str) -> str:
    """The path, or a ValueError if it leads out of its folder."""
    if not path or path.startswith("/") or ".." in path.replace("\\", "/").split("/") or (len(path) > 1 and path[1] == ":"):
        raise ValueError(f"unsafe path in archive: {path!r}")
    return path


def _read(archive: bytes | memoryview) -> Iterator[tuple[str, bytes]]:
    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(archive):
            raise ValueError("the archive is cut short")
        at += n
        return bytes(archive[at - n : at])

    at = 0
    for _ in range(struct.unpack("<I", take(4))[0]):
        path = safe_path(take(struct.unpack("<I", take(4))[0]).decode())
        yield path, take(struct.unpack("<Q", take(8))[0])


def unpack_entries(archive: bytes) -> list[tuple[str, bytes]]:
    return list(_read(archive))


def _read_zip(data: bytes | memoryview, key: Callable[[str], list[bytes]] | None = None) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [(i.filename.replace("\\", "/"), i) for i in z.infolist() if i.filename and not i.filename.endswith("/")]
        names.sort(key=lambda x: x[0].encode())
        if key:
            names.sort(key=lambda x: key(x[0]))
        for n, i in names:
            yield safe_path(n), z.read(i)


def zip_entries(data: bytes) -> list[tuple[str, bytes]]:
    """Files of a ZIP, directories left out, separators forward, in bytewise order of their names."""
    return list(_read_zip(data))


def zip_write(entries: list[tuple[str, bytes]]) -> bytes:
    """Deflate 6; the date is fixed, so that equal entries give equal bytes."""
    return bytes(_made(_Zip, entries))


# An archive on its way through a task is (the row's other columns, one value each; its bytes). Steps are generators of these and hold one archive at a time, however many a batch or a
# task has. Steps that follow each other directly run in one Python worker: a frame that they made remembers how.


def _value(data) -> pa.Array:
    """A column of one binary value, without a copy."""
    if len(data) > 2**31 - 1:
        raise ValueError("an archive of more than 2 GiB is no value: pieces, or volumes, are for these")
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])


def _gathering(by: int, kind: type):
    """From rows (by, relative_path, content) sorted by all but the last: an archive for each value of ``by``. Without ``by``, the first row is no entry."""

    def run(found):
        own, key, out = None, None, None
        for batch in found:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:by]), strict=True)) if by else [()] * batch.num_rows
            paths, data = batch.columns[by:]
            for row, (k, path) in enumerate(zip(keys, paths.to_pylist(), strict=True)):
                if out is None or k != key:
                    if out is not None:
                        yield own, out.done()
                    own, key, out = [c.take(pa.array([row])) for c in batch.columns[:by]], k, kind()
                    if not by:
                        continue
                out.add(path, data[row].as_py())
        if out is not None:
            yield own, out.done()

    return run


def _standing(at: int):
    """Archives that are a column of the rows."""

    def run(found):
        for batch in found:
            for row in range(batch.num_rows):
                yield [c.take(pa.array([row])) for k, c in enumerate(batch.columns) if k != at], memoryview(batch.column(at)[row].as_buffer())

    return run


def _turning(f):
    def run(found):
        for own, data in found:
            data = f(data)
            yield own, data
            del data  # else it stands beside the next one

    return run


def _archives(names: list[str]):
    def run(found):
        for own, data in found:
            yield pa.RecordBatch.from_arrays([*own, _value(data)], [*names, "archive"])
            del data

    return run


def _entries(names: list[str], read):
    """A row an entry, in batches of few bytes."""

    def rows(own, first, held):
        n, paths, data = len(held), *map(list, zip(*held, strict=True))
        parts = [pa.array(range(first, first + n), pa.int32()), pa.array(paths, pa.string()), pa.array(map(len, data), pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(n, int))) for c in own), *parts], [*names, "idx", "relative_path", "data_size", "data"])

    def run(found):
        for own, data in found:
            first, held, size = 0, [], 0
            for path, value in read(data):
                held.append((path, value))
                size += len(value) + 512
                if size > batches.STRETCH:
                    yield rows(own, first, held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield rows(own, first, held)
            del data, held

    return run


def _way(archives: DataFrame) -> tuple:
    """(frame that the worker reads, fields beside the archive, steps)"""
    if way := archives.__dict__.get("_octet_way"):
        return way
    at = archives.columns.index("archive")
    return archives, [f for k, f in enumerate(archives.schema) if k != at], (_standing(at),)


def _frame(way: tuple, columns: list[str]) -> DataFrame:
    source, fields, steps = way
    out = _run(source, (*steps, _archives([f.name for f in fields])), [*fields, StructField("archive", BinaryType())])
    out = out if out.columns == columns else out.select(*columns)
    out._octet_way = way
    return out


def _run(source: DataFrame, steps: tuple, fields: list[StructField]) -> DataFrame:
    return source.mapInArrow(lambda found: reduce(lambda x, step: step(x), steps, found), StructType(fields))


def _gather(files: DataFrame, by: list[str], kind: type, order: Column) -> DataFrame:
    rows = files.select(*by, "relative_path", "content")
    if not by:  # one archive, also of nothing
        rows = rows.unionByName(files.sparkSession.range(1).select(F.lit(None).cast("string").alias("relative_path"), F.lit(None).cast("binary").alias("content")))
    dealt = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, order)
    return _frame((dealt, list(rows.schema)[: len(by)], (_gathering(len(by), kind),)), [*by, "archive"])


def pack(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, archive): one archive for each value of ``by``. ``files``: (by, relative_path, content). An archive is one value, of 2 GiB at most; for larger ones there
    is ``pieces``. Rows are sorted and come to the archive one by one: a task holds the archive that it makes, however many it has to make."""
    return _gather(files, by, _Pack, component_order(F.col("relative_path")))


def zip_pack(files: DataFrame, by: list[str]) -> DataFrame:
    return _gather(files, by, _Zip, F.col("relative_path"))


def _rows(archives: DataFrame, read) -> DataFrame:
    source, fields, steps = _way(archives)
    rest = [c for c in archives.columns if c != "archive"]
    return _run(source, (*steps, _entries([f.name for f in fields], read)), [*fields, *StructType.fromDDL(_ROWS)]).select(*rest, "idx", "relative_path", "data_size", "data")


def unpack(archives: DataFrame) -> DataFrame:
    """A row an entry: idx, relative_path, data_size, data. Unsafe paths and truncated archives fail."""
    return _rows(archives, _read)


def zip_unpack(archives: DataFrame) -> DataFrame:
    return _rows(archives, _read_zip)


def _turned(archives: DataFrame, f) -> DataFrame:
    source, fields, steps = _way(archives)
    return _frame((source, fields, (*steps, _turning(f))), archives.columns)


def zip_to_archive(archives: DataFrame) -> DataFrame:
    return _turned(archives, lambda x: _made(_Pack, _read_zip(x, _components)))


def archive_to_zip(archives: DataFrame) -> DataFrame:
    return _turned(archives, lambda x: _made(_Zip, _read(memoryview(x))))
