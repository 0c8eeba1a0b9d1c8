"""Text pairs to fixed-length id rows and back."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, non_empty
from ..schemas import IGNORED_LABEL
from .loading import loaded, named
from .lookup import MAX_ENTRIES, translate_arrays

INTS = "array<int>"


def pieces(text: Column) -> Column:
    """Whitespace-separated pieces of a text."""
    return non_empty(F.split(text, f"{SPACE}+"))


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def pad_to(ids: Column, length: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def attention_mask(ids: Column, length: int | None = None) -> Column:
    """1 per id, then 0 up to ``length``."""
    ones = F.array_repeat(F.lit(1), F.size(ids))
    return ones if length is None else pad_to(ones, length, 0)


def mask_labels(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == pad, F.lit(IGNORED_LABEL)).otherwise(x))


def unmask_labels(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORED_LABEL, F.lit(pad)).otherwise(x))


def _finish(df: DataFrame, keys: list[str], max_source: int, max_target: int, pad: int | None,
            ignore_pad: bool) -> DataFrame:
    """Truncated ``source_ids``/``target_ids`` to model inputs; ``pad=None`` leaves lengths as they are."""
    source, target = F.col("source_ids"), F.col("target_ids")
    if pad is None:
        return df.select(*keys, source.alias("input_ids"), attention_mask(source).alias("attention_mask"),
                         target.alias("labels"))
    labels = pad_to(target, max_target, pad)
    return df.select(
        *keys, pad_to(source, max_source, pad).alias("input_ids"),
        attention_mask(source, max_source).alias("attention_mask"),
        (mask_labels(labels, pad) if ignore_pad else labels).alias("labels"))


def encode_pairs(pairs: DataFrame, vocab: DataFrame, max_source: int, max_target: int, pad: int | None = None,
                 ignore_pad: bool = True, prefix: str = "", unk: int = 0, text_col: str = "text",
                 summary_col: str = "summary", keys: tuple[str, ...] = (), max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Word ids from a ``(token, id)`` table, as ``input_ids``, ``attention_mask``, ``labels``.

    Texts are cut to the maximum length before their words are looked up.
    """
    cut = pairs.select(
        *keys,
        truncate(pieces(F.concat(F.lit(prefix), F.col(text_col))), max_source).alias("source_ids"),
        truncate(pieces(F.col(summary_col)), max_target).alias("target_ids"))
    cut = translate_arrays(cut, ("source_ids", "target_ids"), vocab, "token", "id", unk, max_entries)
    return _finish(cut, list(keys), max_source, max_target, pad, ignore_pad)


Tokenizer = Callable[[list[str], int], list[list[int]]]


def encode_with(pairs: DataFrame, tokenizer: Callable[[], Tokenizer], max_source: int,
                max_target: int, pad: int | None = None, ignore_pad: bool = True, prefix: str = "",
                text_col: str = "text", summary_col: str = "summary", keys: tuple[str, ...] = (),
                target_tokenizer: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """Like :func:`encode_pairs` with a caller's tokenizer.

    ``tokenizer`` is a loader, called once per Python worker. What it returns gets a batch of texts and the
    maximum length and gives lists of at most that many ids; so it can end cut texts as it ends others.
    ``target_tokenizer`` encodes the summaries, where they need another one.
    """
    def encoder(load: Callable[[], Tokenizer], longest: int):
        name = named(load)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids(texts: pa.Array) -> pa.Array:
            present = texts.fill_null("").to_pylist()
            found = loaded(name, load)(present, longest)
            if len(found) != len(present) or any(len(f) > longest for f in found):
                raise ValueError(f"the tokenizer must give one list of at most {longest} ids per text")
            return pa.array(found, pa.list_(pa.int32()))

        return ids

    cut = pairs.select(
        *keys, encoder(tokenizer, max_source)(F.concat(F.lit(prefix), F.col(text_col))).alias("source_ids"),
        encoder(target_tokenizer or tokenizer, max_target)(F.col(summary_col)).alias("target_ids"))
    return _finish(cut, list(keys), max_source, max_target, pad, ignore_pad)


def decode(df: DataFrame, vocab: DataFrame, pad: int, column: str = "labels", special: tuple[int, ...] = (),
           out: str = "text", unk: str = "", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Ids to space-joined words: ignored positions count as padding, padding and special ids are skipped."""
    return decode_columns(df, vocab, pad, {out: column}, special, unk, max_entries)


def decode_columns(df: DataFrame, vocab: DataFrame, pad: int, columns: dict[str, str], special: tuple[int, ...] = (),
                   unk: str = "", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """:func:`decode` of several columns, given by the names of their texts; the vocabulary is evaluated once for all."""
    skipped = [pad, *special]
    kept = {out: F.filter(unmask_labels(F.col(column), pad), lambda x: ~x.isin(*skipped)) for out, column in columns.items()}
    words = translate_arrays(df.withColumns(kept), tuple(columns), vocab, "id", "token", unk, max_entries)
    return words.withColumns({out: F.concat_ws(" ", non_empty(F.col(out))) for out in columns})


def non_pad_count(ids: Column, pad: int) -> Column:
    return F.size(F.filter(ids, lambda x: x != pad))


def generated_length(df: DataFrame, pad: int, column: str = "input_ids") -> DataFrame:
    """Mean number of ids that are not padding, four decimals."""
    return df.agg(F.round(F.avg(non_pad_count(F.col(column), pad)), 4).alias("gen_len"))
