"""The pipeline, stage by stage, against brute force over its own input."""

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import brute
from tracelake.llm import bpe, quality_rules


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules.judged(docs).where("kept").collect()}
    rows = {d: t for d, t in rows.items() if d in kept}
    groups = brute.components(rows.items(), 5, 80, 100)
    rows = {d: t for d, t in rows.items() if groups[d][1] == d}
    want = brute.substrings(rows.items())
    out = corpus_pipeline.STAGES[2][1](spark, docs.where(docs["doc_id"].isin(list(rows))), SMALL)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(want[d][1] == 0 or brute.sha(t) == want[d][2] for d, t in rows.items())
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = brute.contaminated(rows.items(), items)
    rows = {d: t for d, t in rows.items() if not bad[d][4]}
    coder = bpe.coder(bpe.vocabulary_path()).tokenizer
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(rows)
    for d, t in rows.items():
        ids = coder.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), brute.sha(" ".join(map(str, ids))))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
