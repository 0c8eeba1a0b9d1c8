import corpus_pipeline
from sectionweave.llm import html_blocks, packing, rules, secrets, simhash
from sectionweave.llm.queries import ORACLE, QUERIES


def test_stages_on_all_kinds_of_rows(spark, documents):
    names, docs = documents.columns, documents
    before = documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    kept = docs.collect()
    texts = [simhash.fingerprint(r.text or "") for r in kept]
    assert kept and all((a ^ b).bit_count() > 3 for i, a in enumerate(texts) for b in texts[:i])
    assert all(not secrets.scan(r.text or "")[0] for r in kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept}
    assert corpus_pipeline.STAGES[-1][1](spark, documents.limit(0), "").count() == 0


def test_names_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
    assert rules.CURRENT in rules.POLICIES and packing.CAPACITY == 2048 and html_blocks.tree()
