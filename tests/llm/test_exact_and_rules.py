import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F
from sectionweave.llm import dedup_index, rules

SPACE = r"[\x20\x09-\x0D]"


def test_membership(documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(SPACE, "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, text or "", doc_id))
    got = dedup_index.membership(documents).collect()
    assert len(got) == len(rows)
    keeps = {hashlib.sha256(n.encode()).hexdigest(): (min(g)[4], len(g)) for n, g in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == keeps[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got).keys() == keeps.keys()
    assert {r.text_sha256 for r in got if r.kept} == keeps.keys()
    kept = dedup_index.drop_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(hashlib.sha256(re.sub(SPACE, "", r.text or "").encode()).hexdigest() for r in kept.collect()) == sorted(keeps)
    assert dedup_index.membership(no_documents).count() == dedup_index.drop_duplicates(no_documents).count() == 0


def test_index_persists_and_grows(spark, tmp_path):
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  b  "), (5, "d"), (6, None), (7, "d")], "doc_id long, text string")
    index = dedup_index.DigestIndex(spark, str(tmp_path), "grows", buckets=4)
    assert sorted(r.doc_id for r in dedup_index.drop_duplicates(first, index).collect()) == [1, 3]
    again = dedup_index.DigestIndex(spark, str(tmp_path), "grows", buckets=4)
    plan = again.fresh(dedup_index.representatives(dedup_index.digests(second)))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup_index.membership(second, again).collect()}
    assert got == {4: (1, 1, False), 5: (5, 2, True), 7: (5, 2, False), 6: (6, 1, True)}
    assert dedup_index.drop_duplicates(second, again).count() == 0
    assert again.rows().count() == 4


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_and_verdicts(spark, documents, no_documents):
    more = ["a b c d e " * 3, "a b c d e a b c d e", "x a b c d e y a b c d e a", "q\nq\n \nq", "a b c d e f a b c d e f g", "#*$%&|<> é", "w " * 5, "w " * 6]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in df.collect()]
    got = rules.verdicts(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((i, *brute_rules(t)) for i, t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (r.fail_bits & rules.mask("v2") == 0) and not (r.kept and r.base_failed)
    kept = rules.filter_documents(documents)
    assert kept.columns == documents.columns and kept.schema == documents.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rules.verdicts(documents).where("kept").collect())
    assert rules.verdicts(no_documents).count() == rules.filter_documents(no_documents).count() == 0


def test_ablation(spark, documents):
    entries = rules.ledger(documents)
    bits = [r.fail_bits for r in entries.collect()]
    for policy in ("v1", "v2"):
        got = {r.rule: tuple(r[1:]) for r in rules.ablation(entries, policy).collect()}
        whole = rules.mask(policy)
        assert got == {n: (sum(bool(b & rules.BITS[n]) for b in bits), sum(b & whole == rules.BITS[n] for b in bits),
                           sum(b & whole & ~rules.BITS[n] == 0 for b in bits)) for n in rules.POLICIES[policy]}
    assert rules.ablation(entries.where(F.lit(False))).count() == 0
