import hashlib
import random

import pytest

from octetflow.operators import delta
from octetflow.operators.chunking import cuts


def by_hand(src, dst):
    """Last position of equal chunk bytes wins; what is not copied is inserted."""
    last = {src[p : p + n]: p for p, n, _ in cuts(src)}
    ops, at = [], 0
    for p, n, _ in cuts(dst):
        if dst[p : p + n] in last:
            if p > at:
                ops.append(("INSERT", None, at, p - at))
            ops.append(("COPY", last[dst[p : p + n]], p, n))
            at = p + n
    return ops + ([("INSERT", None, at, len(dst) - at)] if len(dst) > at else [])


def versions():
    r = random.Random(5)
    base = r.randbytes(20_000)
    return {
        "same": (base, base), "edited": (base, base[:5000] + b"!" + base[5001:]), "inserted": (base, base[:7000] + b"new" + base[7000:]), "repeated": (base + base, base),
        "gone": (base, b""), "new": (None, base[:3000]), "other": (base, r.randbytes(4000)), "empty": (b"", b""),
    }


def frames(spark):
    v = versions()
    first = spark.createDataFrame([(k, a) for k, (a, _) in v.items() if a is not None], "path string, content binary")
    return first, spark.createDataFrame([(k, b) for k, (_, b) in v.items()], "path string, content binary")


@pytest.mark.parametrize("diff", [delta.diff_ops, delta.diff_by_join])
def test_ops(spark, diff):
    got = {}
    for r in diff(*frames(spark)).orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.op, r.src_pos, r.dst_pos, r.len))
    assert got == {k: ops for k, (a, b) in versions().items() if (ops := by_hand(a or b"", b))}


def test_round_trip_and_sizes(spark):
    first, second = frames(spark)
    patches = delta.make_patches(first, second)
    back = {r.path: bytes(r.content) for r in delta.apply_patches(first, patches).collect()}
    assert back == {k: b for k, (_, b) in versions().items()}
    stored = {r.path: (bytes(r.patch), r.dst_sha256) for r in patches.collect()}
    assert all(sha == hashlib.sha256(versions()[k][1]).hexdigest() for k, (_, sha) in stored.items())
    sizes = {r.path: r.patch_bytes for r in delta.patch_sizes(delta.diff_ops(first, second), second).collect()}
    assert sizes == {k: len(p) for k, (p, _) in stored.items()}
    rows = delta.patch_rows(patches).filter("path = 'edited'").orderBy("seq").collect()
    assert [(r.op, r.src_pos, r.dst_pos, r.len) for r in rows] == by_hand(*versions()["edited"])


def test_damaged_patches():
    src, dst = versions()["edited"]
    good = delta.write_patch(dst, by_hand(src, dst))
    assert delta.apply_patch(src, good) == dst
    for bad in (b"", good[:5], b"\0" + good[1:], good[:-1], good + b"\7", good[:1] + b"\1" + good[2:]):
        with pytest.raises(ValueError):
            delta.apply_patch(src, bad)
    with pytest.raises(ValueError):
        delta.apply_patch(src[:100], good)
