"""Corpus BLEU (Papineni et al. 2002) with the customary tokenization and smoothing."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.overlap import clipped_overlap, ngram_overlap, ngram_total, ngrams
from ..functions.text import non_empty

MAX_ORDER = 4

# The mteval-13a tokenization rules, applied in this order.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOKEN_RULES = (
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def bleu_tokens(text: Column) -> Column:
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in TOKEN_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return non_empty(F.split(text, r"\s+"))


def closest_length(length: Column, lengths: Column) -> Column:
    """Of several reference lengths the closest to ``length``, the shorter of two; 0 without any."""
    nearest = F.array_min(F.transform(lengths, lambda n: F.struct(F.abs(n - length).alias("apart"), n.alias("n"))))
    return F.coalesce(nearest["n"], F.lit(0))


def _grams_of_each(lists: str, n: int) -> Column:
    return F.transform(lists, lambda tokens: ngrams(tokens, n))


def bleu_counts(pairs: DataFrame) -> DataFrame:
    """One row of sums over all pairs: lengths, matches and totals per n-gram order.

    ``target_sum`` is a text, or an array of several references: a gram then counts at most as often as in the
    reference that has most of it, and the closest reference gives the length. Nulls among references are left out;
    without references nothing matches.
    """
    orders = range(1, MAX_ORDER + 1)
    cand = bleu_tokens(F.col("gen_sum")).alias("cand")
    if isinstance(pairs.schema["target_sum"].dataType, T.ArrayType):
        given = F.coalesce("target_sum", F.array().cast("array<string>"))
        refs = F.transform(F.filter(given, lambda r: r.isNotNull()), bleu_tokens)
        counted = pairs.select(refs.alias("refs"), cand).select(
            F.size("cand").alias("gen_len"), closest_length(F.size("cand"), F.transform("refs", F.size)).alias("ref_len"),
            *(clipped_overlap(ngrams(F.col("cand"), n), _grams_of_each("refs", n)).alias(f"match{n}") for n in orders),
            *(ngram_total(F.col("cand"), n).alias(f"total{n}") for n in orders))
    else:
        tokens = pairs.select(bleu_tokens(F.col("target_sum")).alias("ref"), cand)
        counted = tokens.select(
            F.size("cand").alias("gen_len"), F.size("ref").alias("ref_len"),
            *(ngram_overlap(F.col("ref"), F.col("cand"), n).alias(f"match{n}") for n in orders),
            *(ngram_total(F.col("cand"), n).alias(f"total{n}") for n in orders))
    return counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns))


def _log_precision(order: int) -> Column:
    """Log of the percent precision; an order without match counts 1 / 2^k, k such orders so far."""
    matches, total = F.col(f"match{order}"), F.col(f"total{order}")
    misses = reduce(lambda a, b: a + b, (
        F.when(F.col(f"match{n}") == 0, 1).otherwise(0) for n in range(1, order + 1)))
    return F.log(F.when(matches > 0, 100 * matches / total).otherwise(100 / (F.pow(F.lit(2), misses) * total)))


def bleu_of_counts() -> Column:
    """BLEU in percent over the columns of :func:`bleu_counts`, zero when an order has no n-gram or nothing matches."""
    orders = range(1, MAX_ORDER + 1)
    gen_len, ref_len = F.col("gen_len"), F.col("ref_len")
    penalty = F.when(gen_len < ref_len, F.exp(1 - ref_len / gen_len)).otherwise(F.lit(1.0))
    mean_log = reduce(lambda a, b: a + b, map(_log_precision, orders)) / MAX_ORDER
    any_match = reduce(lambda a, b: a | b, (F.col(f"match{n}") > 0 for n in orders))
    scorable = (F.col(f"total{MAX_ORDER}") > 0) & any_match
    return F.when(scorable, penalty * F.exp(mean_log)).otherwise(F.lit(0.0))


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """BLEU of all pairs; ``target_sum`` may hold one reference or an array of them."""
    return bleu_counts(pairs).select(bleu_of_counts().alias("bleu"))
