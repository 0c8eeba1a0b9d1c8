import hashlib
import random
import re

import pytest

from sectionweave.llm import infill


def brute(doc_id, text):
    """The contract, with a list of lines instead of a set of positions."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(lines)
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


CASES = {
    "run": "\n" * 70_000 + "x" * 70_000 + "\n" * 3,
    "bitmap": "a\né\n\n\U0001f600" * 40_000,
    "array": ("x" * 999 + "\n") * 300,
    "one_line": "y" * 200_000,
    "exact_container": "z" * 65_535 + "\n",
    "break_first_in_container": "z" * 65_536 + "\nq",
    "marker": "a\n<S>\nb", "nearly_marker": "a\n<S\n>b<", "empty": "", "breaks": "\n\n", "returns": "a\r\nb\rc d\x0be",
}


@pytest.mark.parametrize("name", CASES)
def test_select_and_forms(name):
    text = CASES[name]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    ends = infill.Boundaries(text)
    assert len(ends) == len(lines)
    rng, place, wanted = random.Random(3), 0, {0: 0}
    for i, line in enumerate(lines, 1):
        place += len(line)
        wanted[i] = place
    for k in {0, len(lines), len(lines) // 2, *(rng.randint(0, len(lines)) for _ in range(200))}:
        assert ends.offset(k) == wanted[k]
    for doc_id in (None, 0, 5, -7, *range(100, 130)):
        found = infill.rearranged(doc_id, text)
        assert found == brute(doc_id, text)
        assert infill.original(found[1], found[4]) == text


def test_every_kind_of_container():
    kinds = {name: {type(c).__name__ for c in infill.Boundaries(CASES[name]).containers} for name in ("run", "bitmap", "array")}
    assert kinds == {"run": {"RunContainer"} | kinds["run"], "bitmap": {"BitmapContainer"}, "array": {"ArrayContainer"}}


def test_rates():
    forms = [infill.rearranged(i, "a\nb\n", rate=30, suffix_first=100)[1] for i in range(2000)]
    assert 500 < forms.count("spm") < 700 and forms.count("psm") == 0 and forms.count("plain") == 2000 - forms.count("spm")


def test_on_all_kinds_of_rows(spark, documents, no_documents):
    filled = infill.fill_in_middle(documents)
    found = sorted(map(tuple, filled.collect()), key=repr)
    assert found == sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in documents.collect()), key=repr)
    back = sorted(((r.doc_id, r.text) for r in infill.restore(filled).collect()), key=repr)
    assert back == sorted(((r.doc_id, r.text or "") for r in documents.collect()), key=repr)
    assert infill.digests(no_documents).count() == 0 and infill.digests(documents).count() == documents.count()
