"""N-gram overlap as array expressions: no explode, no shuffle, no Python."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, no_strings


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of ``n`` tokens."""
    if n == 1:
        return tokens
    return let(tokens, lambda t: F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(0), F.size(t) - n),
                    lambda i: F.concat_ws(" ", *(F.get(t, i + k) for k in range(n)))),
    ).otherwise(no_strings()))


def _merge_step(a: Column, b: Column):
    """One step of walking two sorted arrays: move past the smaller head, or past both and count."""
    def step(state: Column, _: Column) -> Column:
        x, y = F.get(a, state["i"]), F.get(b, state["j"])
        both = x == y
        first = F.coalesce(x <= y, F.lit(True))
        second = F.coalesce(y <= x, F.lit(True))
        one, zero = F.lit(1), F.lit(0)
        return F.struct(
            (state["i"] + F.when(first, one).otherwise(zero)).alias("i"),
            (state["j"] + F.when(second, one).otherwise(zero)).alias("j"),
            (state["hits"] + F.when(both, one).otherwise(zero)).alias("hits"),
        )
    return step


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two string arrays, in n log n."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("hits"))
    return let(F.sort_array(left), lambda a: let(F.sort_array(right), lambda b: F.aggregate(
        F.sequence(F.lit(1), F.size(a) + F.size(b)), start, _merge_step(a, b), lambda s: s["hits"])))


def _clip_step(candidate: Column, references: Column):
    """One step of walking sorted grams beside those of all references: references that lag behind catch up, else a candidate gram is counted."""
    def step(state: Column, _: Column) -> Column:
        x = F.get(candidate, state["i"])
        heads = F.transform(references, lambda r, k: F.get(r, F.get(state["at"], k)))

        def moved(h: Column) -> Column:
            lags = F.exists(h, lambda y: y < x)
            passed = F.when(lags, 0).otherwise(1)
            at = F.zip_with(state["at"], h, lambda j, y: j + F.when(F.when(lags, y < x).otherwise(y == x), 1).otherwise(0))
            found = F.when(~F.coalesce(lags, F.lit(False)) & F.coalesce(F.exists(h, lambda y: y == x), F.lit(False)), 1).otherwise(0)
            return F.struct((state["i"] + passed).alias("i"), at.alias("at"), (state["hits"] + found).alias("hits"))

        # Ends of arrays are null: a reference at its end never lags, and behind the last candidate gram nothing happens.
        return F.when(x.isNull(), state).otherwise(let(F.transform(heads, lambda y: F.coalesce(y, F.lit("\U0010ffff"))), moved))
    return step


def clipped_overlap(candidate: Column, references: Column) -> Column:
    """Elements of ``candidate``, each counted at most as often as the one of the ``references`` (an array of arrays) that has most of it."""
    def walk(c: Column, r: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.transform(r, lambda _: F.lit(0)).alias("at"), F.lit(0).alias("hits"))
        steps = F.aggregate(r, F.size(c), lambda n, one: n + F.size(one))
        return F.when((F.size(c) == 0) | (F.size(r) == 0), 0).otherwise(
            F.aggregate(F.sequence(F.lit(1), steps), start, _clip_step(c, r), lambda s: s["hits"]))

    return let(F.sort_array(candidate), lambda c: let(F.transform(references, lambda r: F.sort_array(r)), lambda r: walk(c, r)))


def ngram_overlap(left: Column, right: Column, n: int) -> Column:
    return multiset_overlap(ngrams(left, n), ngrams(right, n))


def ngram_total(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def f_score(hits: Column, candidate_total: Column, reference_total: Column) -> Column:
    """``struct(precision, recall, fmeasure)``, zeros where there is nothing to divide by."""
    def ratio(h: Column, total: Column) -> Column:
        return F.when(total > 0, h / total).otherwise(F.lit(0.0))

    def scores(v: Column) -> Column:
        p, r = v["p"], v["r"]
        harmonic = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return F.struct(p.alias("precision"), r.alias("recall"), harmonic.alias("fmeasure"))

    def ratios(h: Column) -> Column:
        return F.struct(ratio(h, candidate_total).alias("p"), ratio(h, reference_total).alias("r"))

    return let(hits, lambda h: let(ratios(h), scores))
