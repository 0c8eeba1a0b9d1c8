"""Text-overlap scores of (target_sum, gen_sum) pairs.

A pair is one row and each score is a projection of it: n-gram overlap and the
arithmetic are Spark expressions, only stems and LCS lengths come from an Arrow UDF.
No operator here shuffles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lcs import LINE, lcs_len, stemmed_pair, summary_lcs
from ..functions.overlap import f_score, ngram_overlap, ngram_total
from ..functions.text import normalize, normalized_tokens, percent, token_count

METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
TARGET, GENERATED = "target_sum", "gen_sum"


def _normalized_lines(text: Column) -> Column:
    """Each line normalized by itself, line breaks kept."""
    return F.array_join(F.transform(F.split(text, LINE), normalize), LINE)


def _prepared(pairs: DataFrame, metrics: tuple[str, ...], use_stemmer: bool) -> DataFrame:
    """Add both texts normalized (``ref``, ``cand``) once for all metrics, and the LCS lengths that these need."""
    plain, by_line = "rougeL" in metrics, "rougeLsum" in metrics
    ref, cand = _normalized_lines(F.col(TARGET)), _normalized_lines(F.col(GENERATED))
    if use_stemmer:
        # One Python step stems the texts and compares them.
        df = pairs.withColumn("stemmed", stemmed_pair(ref, cand, F.lit(plain), F.lit(by_line)))
        df = df.select(*pairs.columns, "stemmed.*")
        return df.withColumn("ref", _flat("ref_lines")).withColumn("cand", _flat("cand_lines"))
    df = pairs.withColumn("ref_lines", ref).withColumn("cand_lines", cand)
    df = df.withColumn("ref", _flat("ref_lines")).withColumn("cand", _flat("cand_lines"))
    df = df.withColumn("lcs", lcs_len("ref", "cand")) if plain else df
    return df.withColumn("lsum", summary_lcs("ref_lines", "cand_lines")) if by_line else df


def _flat(name: str) -> Column:
    """Normalized lines as one normalized text."""
    return F.trim(F.regexp_replace(F.col(name), r"\n+", " "))


def score_structs(pairs: DataFrame, metrics: tuple[str, ...] = METRICS, use_stemmer: bool = False) -> DataFrame:
    """Add one ``struct(precision, recall, fmeasure)`` column per metric, values in 0..1."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; known: {', '.join(METRICS)}")
    ref_size, cand_size = token_count(F.col("ref")), token_count(F.col("cand"))
    df = _prepared(pairs, metrics, use_stemmer)
    df = df.withColumn("ref_tokens", normalized_tokens(F.col("ref")))
    df = df.withColumn("cand_tokens", normalized_tokens(F.col("cand")))

    def score(metric: str) -> Column:
        if metric in ("rougeL", "rougeLsum"):
            return f_score(F.col("lcs" if metric == "rougeL" else "lsum"), cand_size, ref_size)
        n = int(metric[-1])
        ref, cand = F.col("ref_tokens"), F.col("cand_tokens")
        return f_score(ngram_overlap(ref, cand, n), ngram_total(cand, n), ngram_total(ref, n))

    return df.select(*pairs.columns, *(score(m).alias(m) for m in metrics))


def _score_rows(pairs: DataFrame, metric: str, use_stemmer: bool) -> DataFrame:
    keys = [c for c in pairs.columns if c not in (TARGET, GENERATED)]
    return score_structs(pairs, (metric,), use_stemmer).select(*keys, F.lit(metric).alias("metric"), f"{metric}.*")


def rouge_n(pairs: DataFrame, n: int, use_stemmer: bool = False) -> DataFrame:
    """Clipped n-gram overlap, one row of precision, recall and F per pair."""
    return _score_rows(pairs, f"rouge{n}", use_stemmer)


def rouge_l(pairs: DataFrame, use_stemmer: bool = False) -> DataFrame:
    return _score_rows(pairs, "rougeL", use_stemmer)


def rouge_lsum(pairs: DataFrame, use_stemmer: bool = False) -> DataFrame:
    """Union LCS over newline-separated sentences."""
    return _score_rows(pairs, "rougeLsum", use_stemmer)


def score_pairs(pairs: DataFrame, use_stemmer: bool = False) -> DataFrame:
    """F of every metric in percent, four decimals."""
    scored = score_structs(pairs, METRICS, use_stemmer)
    return scored.select(*pairs.columns, *(percent(F.col(m)["fmeasure"]).alias(m) for m in METRICS))
