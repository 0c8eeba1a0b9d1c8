"""Replace array elements through a lookup table."""

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import spelt_list
from ..session import stored

# A table may be broadcast up to this many entries and bytes.
MAX_ENTRIES = 2_000_000
MAX_BYTES = 64 << 20
# Keys that are objects at a time, while they are hashed.
HASHED_ROWS = 1 << 16


def _unique(table: DataFrame, key: str, value: str) -> DataFrame:
    """One entry per key, the smallest value; a null key matches nothing."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("item")).agg(F.min(value).alias("found"))


def _is_small(table: DataFrame, max_entries: int) -> bool:
    size = F.coalesce(F.sum(sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("item", "found"))), F.lit(0))
    entries, text = table.agg(F.count("*"), size).first()
    return entries <= max_entries and text <= MAX_BYTES


class Index(NamedTuple):
    """Keys in the order of their hashes, and the value of each: flat arrays, so a worker holds no object per entry."""

    hashes: np.ndarray
    keys: pa.Array
    values: pa.Array
    #: How many keys share a hash at most.
    longest_run: int


def _hashes(items: pa.Array) -> np.ndarray:
    filled = items.fill_null("" if pa.types.is_string(items.type) or pa.types.is_large_string(items.type) else 0)
    return pd.util.hash_array(filled.to_numpy(zero_copy_only=False), categorize=False)


def build_index(keys: pa.Array, values: pa.Array) -> Index:
    parts = [_hashes(keys.slice(at, HASHED_ROWS)) for at in range(0, len(keys), HASHED_ROWS)]
    hashes = np.concatenate(parts) if parts else np.array([], "u8")
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else hashes
    runs = np.diff(np.append(starts, len(hashes)))
    return Index(hashes, keys.take(pa.array(order)), values.take(pa.array(order)), int(runs.max(initial=0)))


def look_up(index: Index, items: pa.Array) -> pa.Array:
    """The value of each item, null for those without one; equal items are looked up once, equal hashes told apart by their keys."""
    coded = items.dictionary_encode()
    distinct = coded.dictionary.cast(index.keys.type)
    wanted = _hashes(distinct)
    first, places = np.searchsorted(index.hashes, wanted), np.full(len(distinct), -1)
    for step in range(index.longest_run):
        at = np.minimum(first + step, len(index.hashes) - 1)
        same = pc.equal(index.keys.take(pa.array(at)), distinct).fill_null(False).to_numpy(zero_copy_only=False)
        places = np.where(same, at, places)
    return index.values.take(pa.array(places, mask=places < 0)).take(coded.indices)


def _by_broadcast(df: DataFrame, columns: Sequence[str], table: DataFrame, default) -> DataFrame:
    """Rows stay where they are; the table travels once to each executor."""
    entries = table.toArrow()
    keys, values = (pa.concat_arrays(entries[c].chunks) if entries[c].num_chunks else pa.array([], entries[c].type) for c in ("item", "found"))
    shared = df.sparkSession.sparkContext.broadcast(build_index(keys, values))

    @F.arrow_udf(T.ArrayType(table.schema["found"].dataType))
    def translate(arrays: pa.Array) -> pa.Array:
        found = look_up(shared.value, arrays.flatten())
        lengths = pc.fill_null(pc.list_value_length(arrays), 0)
        ends = pc.cumulative_sum(lengths).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, pc.fill_null(found, default), mask=arrays.is_null())

    return df.withColumns({c: translate(c) for c in columns})


def _digest(items: Column) -> Column:
    return F.md5(spelt_list(items.cast("array<string>")))


def _by_join(df: DataFrame, column: str, table: DataFrame, default) -> DataFrame:
    """Distinct arrays are taken apart, joined element by element and put together again.

    A digest stands for the array wherever rows meet: no array is a key, and no row number that a lost
    executor could change. The table is read from files, so both sides of the element join are exchanges
    and the partition of a frequent element can be split.
    """
    keyed = df.withColumn("items_key", F.when(F.col(column).isNotNull(), _digest(F.col(column))))
    distinct = keyed.where("items_key IS NOT NULL").groupBy("items_key").agg(F.first(column).alias("items"))
    elements = distinct.select("items_key", F.posexplode("items").alias("pos", "item"))
    found = F.struct("pos", F.coalesce("found", F.lit(default)).alias("found"))
    translated = (
        elements.join(table, "item", "left").groupBy("items_key")
        .agg(F.transform(F.array_sort(F.collect_list(found)), lambda x: x["found"]).alias("translated"))
    )
    # An empty array explodes to nothing and translates to itself.
    empty = F.array().cast(T.ArrayType(table.schema["found"].dataType))
    result = F.when(F.col(column).isNull(), None).otherwise(F.coalesce("translated", empty))
    return keyed.join(translated, "items_key", "left").select(*(result.alias(c) if c == column else F.col(c) for c in df.columns))


def translate_arrays(df: DataFrame, columns: Sequence[str], table: DataFrame, key: str, value: str, default,
                     max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Map each element of array columns by a table; unknown and null elements become ``default``.

    Of several values of a key the smallest counts. The table is evaluated once. Checked to be small it is
    broadcast and no row moves; any larger table is joined, with the same result.
    """
    table = stored(_unique(table, key, value), "lookup")
    if _is_small(table, max_entries):
        return _by_broadcast(df, columns, table, default)
    return reduce(lambda part, column: _by_join(part, column, table, default), columns, df)
