"""Slow, direct versions of the operators for small fixtures."""

import re
from collections import Counter

from sectionweave.functions.stem import porter
from sectionweave.schemas import KEYWORDS, TRAINING_TYPES


def tokens(text, stem=False):
    found = re.findall("[a-z0-9]+", text.lower())
    return [porter(t) if len(t) > 3 else t for t in found] if stem else found


def lcs_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table


def lcs(a, b):
    return lcs_table(a, b)[-1][-1]


def walk(a, b):
    """Positions in ``a`` of the LCS a textbook walk finds: left only if strictly better."""
    table, i, j, found = lcs_table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def union_hits(ref, cand):
    ref, cand = [s.split() for s in ref.split("\n")], [s.split() for s in cand.split("\n")]
    left, right = Counter(sum(ref, [])), Counter(sum(cand, []))
    hits = 0
    for r in ref:
        for i in sorted(set().union(*(walk(r, c) for c in cand))):
            if left[r[i]] > 0 and right[r[i]] > 0:
                left[r[i]] -= 1
                right[r[i]] -= 1
                hits += 1
    return hits


def overlap(a, b, n):
    def grams(t):
        return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    return sum((grams(a) & grams(b)).values()), sum(grams(b).values()), sum(grams(a).values())


def prf(hits, cand, ref):
    p, r = (hits / cand if cand else 0.0), (hits / ref if ref else 0.0)
    return p, r, (2 * p * r / (p + r) if p + r else 0.0)


def recall_table(abstract, sections, stem):
    def recall(s, section):
        ref = tokens(s, stem)
        return max([lcs(ref, tokens(t, stem)) / len(ref) for t in section or []], default=0.0) if ref else 0.0
    return [[recall(s, section) for s in abstract] for section in sections]


def matches(abstract, sections, stem):
    table = recall_table(abstract, sections, stem)
    return [max(range(len(sections)), key=lambda k: (table[k][m], -k)) for m in range(len(abstract))]


def section_type(header):
    return next((KEYWORDS[w] for w in (header or "").lower().split() if w in KEYWORDS), "o")


def prepare(article, train, stem=True, types=TRAINING_TYPES, min_document=50, min_summary=50):
    names, sections = list(article["section_names"]), list(article["sections"])
    size = max(len(names), len(sections))
    names += [None] * (size - len(names))
    sections += [None] * (size - len(sections))
    abstract = article["abstract_text"]
    owner = matches(abstract, sections, stem)
    rows = []
    for k, (name, section) in enumerate(zip(names, sections)):
        own = [s for m, s in enumerate(abstract) if owner[m] == k]
        document = " ".join(section or [])
        summary = re.sub("</?S>", "", " ".join(own))
        if (own and section_type(name) in types and len(document.split(" ")) > min_document
                and (not train or len(summary.split(" ")) > min_summary)):
            rows.append((article["article_id"], k, section_type(name), document, summary,
                         re.sub("</?S>", "", " ".join(abstract))))
    return rows
