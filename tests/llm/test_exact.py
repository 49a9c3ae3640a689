import hashlib
import uuid

from octetflow.llm.exact import DigestIndex, exact_dedup

SCHEMA = "doc_id long, text string, digest string, n long, keep_id string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_groups(spark):
    texts = ["Abc", "aBC", "abc ", None, "", "É", "é", "ÉA", "Éa", "İ", "x" * 300_000, "X" * 300_000] + ["same"] * 3000
    rows = [(i, t, "c", 1, "c") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    lows = [low(t) for t in texts]
    groups = {}
    for i, t in enumerate(lows):
        groups.setdefault(t, []).append(i)
    for i, t in enumerate(lows):
        group, r = groups[t], got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), i == max(group))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", None, None, None), (5, "A", None, None, None), (5, "a", None, None, None), (None, "b", None, None, None), (None, "b", None, None, None)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 2, True), (None, None, 2, True)], key=str)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_is_kept_across_batches_and_openings(spark):
    name = f"index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, buckets=3)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.kept) for r in index.add(make((1, "a"), (2, "b"))).collect()} == {(1, True), (2, True)}
    spark.sql(f"DROP TABLE {name}")  # the catalogue forgets; the files stay
    again = DigestIndex(spark, name, buckets=3)
    got = {(r.doc_id, r.keep_id, r.kept) for r in again.add(make((3, "A"), (4, "c"), (5, "C"))).collect()}
    assert got == {(3, 1, False), (4, 5, False), (5, 5, True)}
    assert again.table().count() == 3
    assert {r.kept for r in again.add(make((6, "A"), (7, "c"))).collect()} == {False}
    assert again.table().count() == 3
    again.drop()


def test_a_batch_that_failed_can_be_added_again(spark):
    index = DigestIndex(spark, f"index_{uuid.uuid4().hex}", buckets=3)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.add(make((1, "a"))).collect()
    docs = make((3, "A"), (4, "c"), (5, "C"), (6, "d"))
    verdicts = lambda out: {(r.doc_id, r.keep_id, r.kept) for r in out.collect()}
    want = {(3, 1, False), (4, 5, False), (5, 5, True), (6, 6, True)}
    append, index._append = index._append, lambda fresh: append(fresh.filter("keep_id = 6"))  # half of it arrives
    index.add(docs)  # and the verdicts are lost
    index._append = append
    assert verdicts(index.add(docs)) == want  # named after its rows
    assert verdicts(index.add(docs)) == want
    assert index.table().count() == 3
    assert verdicts(index.add(docs, batch="other")) == {(i, k, False) for i, k, _ in want}
    index.drop()
