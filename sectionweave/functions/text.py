"""String and array expressions; everything here stays inside the JVM."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token characters, sentence markers, export markers.
NON_TOKEN = "[^a-z0-9]+"
SENTENCE_MARKER = "</?S>"
LINE_MARKER = "<n>"
# White space of any script, and the separators U+001C to U+001F.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

EMPTY_STRINGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda is evaluated again for every element;
    binding it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def non_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def normalize(text: Column) -> Column:
    """Lower-case runs of ``[a-z0-9]`` separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), NON_TOKEN, " "))


def normalized_tokens(normalized: Column) -> Column:
    """The tokens of a text that went through :func:`normalize`."""
    return F.when(normalized == "", no_strings()).otherwise(F.split(normalized, " "))


def token_count(normalized: Column) -> Column:
    """How many tokens a normalized text holds: separators plus one."""
    return F.when(normalized == "", 0).otherwise(
        F.length(normalized) - F.length(F.replace(normalized, F.lit(" "))) + 1)


def rouge_tokens(text: Column, use_stemmer: bool = False) -> Column:
    return normalized_tokens(rouge_text(text, use_stemmer))


def rouge_text(text: Column, use_stemmer: bool = False) -> Column:
    """Space-separated scoring tokens, stemmed on request."""
    from .stem import stem_text

    return stem_text(normalize(text)) if use_stemmer else normalize(text)


def words(text: Column) -> Column:
    """Lower-case pieces between whitespace, empty ones dropped."""
    return non_empty(F.split(F.lower(text), f"{SPACE}+"))


def first_hit(pieces: Column, table: dict[str, str], default: str) -> Column:
    """Value of the first piece that is a key of a small literal table."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    hits = F.filter(F.transform(pieces, lambda w: F.try_element_at(lookup, w)), lambda v: v.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(default))


def join_sentences(sentences: Column) -> Column:
    return F.concat_ws(" ", sentences)


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, SENTENCE_MARKER, "")


def piece_count(text: Column) -> Column:
    """Number of pieces between single spaces, empty pieces included."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "))) + 1


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def sentence_lines(text: Column) -> Column:
    """One sentence per line: a break after closing punctuation and whitespace."""
    return F.regexp_replace(text, f"([.!?]){SPACE}+", "$1\n")


def sentences(text: Column) -> Column:
    return F.split(sentence_lines(text), "\n")


def postprocess_text(text: Column) -> Column:
    """Strip, then put each sentence on its own line."""
    return sentence_lines(strip(text))


def export_text(text: Column) -> Column:
    """Flatten newlines to spaces and drop line markers."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), LINE_MARKER, "")


def spelt(text: Column) -> Column:
    """A text with its length in front, or ``n`` for null: joined, such values can be told apart again."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def spelt_list(items: Column, spell: Callable[[Column], Column] = spelt) -> Column:
    """The same for an array, with its size in front."""
    whole = F.concat(F.size(items).cast("string"), F.lit("["), F.array_join(F.transform(items, spell), ""), F.lit("]"))
    return F.when(items.isNull(), F.lit("N")).otherwise(whole)


def percent(score: Column) -> Column:
    return F.round(score * 100, 4)
