import corpus_pipeline
from octetflow.llm.bpe import bpe_digests
from octetflow.llm.exact import exact_dedup
from octetflow.llm.mixing import mix
from octetflow.llm.quality import classify

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(x, y):
    return 10 * len(x & y) >= 8 * len(x | y)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_rows = docs.collect()
    ok = {r.doc_id for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    left = {r.doc_id: r for r in all_rows if r.doc_id in ok}
    by_text = {}
    for i, r in left.items():
        t = r.text.encode().lower()
        by_text[t] = max(i, by_text.get(t, -1))
    left = {i: left[i] for i in by_text.values()}
    sets = {i: shingles(r.text) for i, r in left.items()}
    root = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] > root[b] and similar(sets[a], sets[b]):
                    root[a], changed = root[b], True
    left = {i: r for i, r in left.items() if root[i] == i}
    kept = docs.filter(docs.doc_id.isin(list(left)))
    sampled = {r.doc_id for r in mix(kept).collect() if r.sampled}
    want = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe_digests(kept).collect() if r.doc_id in sampled}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(all_rows)


def test_stages_keep_columns_and_take_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, fingerprint string"
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, "Word " * 40_000, "en", "s", 5, "a", "b"), (3, "Word " * 40_000, "en", "s", 5, "a", "b"), (None, "x y", "en", "s", 3, "a", "b")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
    assert exact_dedup(docs).count() == 0
