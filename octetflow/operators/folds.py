"""FNV-1a over byte strings in an order, spread over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetflow.functions import digests

_KINDS = "g string, at string, state string, power string, table binary, n long, size long"
_PART = pa.schema([("g", pa.string()), ("at", pa.string()), ("state", pa.string()), ("power", pa.string()), ("table", pa.binary()), ("n", pa.int64()), ("size", pa.int64())])


def _fold(batches):
    """Sorted (g, at, data, size) to a row a group: its state where it begins in this partition, else its transfer."""
    now, n, size, at, state = None, 0, 0, None, None

    def row():
        if isinstance(state, tuple):
            return {"g": now, "at": at, "state": None, "power": f"{state[0]:016x}", "table": state[1].tobytes(), "n": n, "size": size}
        return {"g": now, "at": at, "state": f"{state:016x}", "power": None, "table": None, "n": n, "size": size}

    for batch in batches:
        out = []
        groups, places, data, sizes = (c.to_pylist() for c in batch.columns)
        starts = [k for k in range(len(groups)) if k == 0 or groups[k] != groups[k - 1]] + [len(groups)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            if now is None or groups[lo] != now:
                if now is not None:
                    out.append(row())
                state = digests.OFFSET if now is not None else (1, np.zeros(256, np.uint64))  # the first may go on from the partition before
                now, n, size, at = groups[lo], 0, 0, places[lo]
            whole = b"".join(data[lo:hi])
            state = digests.chained(state, digests.transfer(whole)) if isinstance(state, tuple) else digests.fnv1a(whole, state)
            n, size = n + hi - lo, size + sum(sizes[lo:hi])
        yield pa.RecordBatch.from_pylist(out, _PART)
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], _PART)


def _finish(parts):
    out = []
    for x in parts.to_pylist():
        h = digests.OFFSET
        for p in sorted(x, key=lambda p: p["at"].encode()):
            h = int(p["state"], 16) if p["state"] else digests.after(h, (int(p["power"], 16), np.frombuffer(p["table"], np.uint64)))
        out.append(f"{h:016x}")
    return pa.array(out, pa.string())


def fnv_in_order(rows: DataFrame) -> DataFrame:
    """(g, fnv, n, size) from (g string, at string, data binary, size long): FNV-1a of each group's data in bytewise order of ``at``, which must tell its rows apart unless they are
    equal; the number of rows; the sum of sizes. Rows are dealt by ranges of (g, at), so a group of any size is spread over tasks; each task folds what it
    has, and the folds of a group are chained (2 KB a task that the group reaches)."""
    sorted_rows = rows.select("g", "at", "data", "size").repartitionByRange("g", "at").sortWithinPartitions("g", "at")
    whole = sorted_rows.mapInArrow(_fold, _KINDS).groupBy("g").agg(F.collect_list(F.struct("at", "state", "power", "table")).alias("p"), F.sum("n").alias("n"), F.sum("size").alias("size"))  # a row a task
    return whole.select("g", F.arrow_udf(_finish, "string")("p").alias("fnv"), "n", "size")
