"""Expressions over the section arrays of an article row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lcs import LINE, PAGE, section_lcs, section_lcs_stemmed, section_matches, section_matches_stemmed
from .text import first_hit, let, normalize, strip_markers, token_count, words
from ..schemas import KEYWORDS, OTHER_SECTION


def identify_section(header: Column, keywords: dict[str, str] = KEYWORDS) -> Column:
    """Type code of the first header word that is a keyword, ``o`` when none is."""
    return first_hit(words(header), keywords, OTHER_SECTION)


def zip_sections(names: Column, texts: Column) -> Column:
    """Pair headers and texts by position, the shorter side padded with nulls, and number them."""
    paired = F.zip_with(names, texts, lambda h, t: F.struct(h.alias("head"), t.alias("text")))
    return F.transform(paired, lambda s, i: F.struct(
        s["head"].alias("section_head"), s["text"].alias("section_text"), i.alias("section_idx")))


def _lines(sentences: Column) -> Column:
    """Normalized sentences, each ended by a newline."""
    return F.array_join(
        F.transform(F.coalesce(sentences, F.array().cast("array<string>")),
                    lambda s: F.concat(F.coalesce(normalize(s), F.lit("")), F.lit(LINE))), "")


def abstract_lines(abstract: Column, strip_markers_first: bool = False) -> Column:
    """Lines of the abstract as the Python step reads them; null for a null abstract, which has no sentences."""
    lines = _lines(F.transform(abstract, strip_markers) if strip_markers_first else abstract)
    return F.when(abstract.isNotNull(), lines)


def _pages(zipped: Column) -> Column:
    """Pages of the sections; null for a null section list, which has no sections."""
    return F.array_join(F.transform(zipped, lambda s: F.concat(_lines(s["section_text"]), F.lit(PAGE))), "")


def section_hits(lines: Column, zipped: Column, use_stemmer: bool = True) -> Column:
    """Section by abstract-sentence LCS table of one article row; ``lines`` are its :func:`abstract_lines`."""
    return (section_lcs_stemmed if use_stemmer else section_lcs)(lines, _pages(zipped))


def _sentences(sentences: Column) -> Column:
    """Sentences as the comparison reads them: ASCII letters and digits count. The letters outside whose small form is ASCII are two;
    only sentences that hold one are normalized here."""
    rare = lambda s: s.contains("\u0130") | s.contains("\u212a")
    return F.transform(sentences, lambda s: F.when(rare(s), normalize(s)).otherwise(s))


def section_best(abstract: Column, sections: Column, use_stemmer: bool = True, strip_markers_first: bool = False) -> Column:
    """Per abstract sentence the first section with the longest LCS: ``best``, and the ``pairs`` of sentences and how many were ``compared``.

    Both are arrays of sentences as they stand, for the sections one array each; null sentences and sections are empty.
    """
    own = F.transform(abstract, strip_markers) if strip_markers_first else abstract
    return (section_matches_stemmed if use_stemmer else section_matches)(_sentences(own), F.transform(sections, _sentences))


def sentence_sizes(lines: Column) -> Column:
    """Scoring tokens of each line of the abstract; behind the last line break stands none."""
    return let(F.split(lines, LINE), lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), token_count))


def recall_table(hits: Column, sizes: Column) -> Column:
    """LCS recall as float, per section and abstract sentence."""
    return let(sizes, lambda n: F.transform(hits, lambda row: F.zip_with(
        row, n, lambda h, k: F.when(k > 0, h / k).otherwise(F.lit(0.0)).cast("float"))))


def scored_matches(best: Column) -> Column:
    """``struct(section_idx, score)`` per abstract sentence, the score being the recall as float; empty where nothing can match."""
    scored = F.transform(best, lambda b: F.struct(
        b["section_idx"].alias("section_idx"),
        F.when(b["n_tokens"] > 0, b["hits"] / b["n_tokens"]).otherwise(F.lit(0.0)).cast("float").alias("score")))
    return F.coalesce(scored, F.array().cast("array<struct<section_idx:int,score:float>>"))
