"""The pipeline's stages, and the whole of it, against plain Python on a small table."""

import hashlib

import corpus_pipeline
from veriloom.llm import packing
from veriloom.llm.queries import oracle_sql, queries, tokenizer_path


def first_of_each_class(texts):
    """Of documents linked by a similarity of 0.8 on sets of five words, by comparing all: the least id of each class."""
    sets = {}
    for d, t in texts.items():
        words = (t or "").lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in texts}


def test_stages_keep_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        gone = set(before) - set(after)
        if name == "language":
            assert all(not any(map(str.isalpha, before[d] or "")) for d in gone)
        if name == "exact_copies":
            keys = ["".join(t.split()) for t in after.values()]
            assert len(set(keys)) == len(keys) and set(keys) == {"".join(t.split()) for t in before.values()}
        if name == "near_copies":
            assert set(after) == first_of_each_class(before)
        if name == "benchmark_passages":
            assert all(any(i in before[d] for i in items) for d in gone) and not any(i in t for i in items for t in after.values())
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    encode = packing.encoder(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for d, pieces in by_doc.items():
        n = len(encode(texts[d])) // 4 + 1
        assert sum(p[1] for p in pieces) == n and {p[2] for p in pieces} == {n}
    assert len({hashlib.sha256(texts[d].encode()).hexdigest() for d in by_doc}) == len(by_doc)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())


def test_native_oracles(spark, duck, sf_dir):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from compare import assert_same

    for name in ("op6_sharding", "op9_exact_dedup", "op10_warc"):
        assert_same(queries()[name](spark, sf_dir), duck, oracle_sql()[name])
