"""Porter (1980) suffix stripping for scoring tokens, as an Arrow UDF.

The rule set is the one scoring libraries use: Porter's steps with the common
extensions (short ``-ies``/``-ied`` words, ``y`` after a consonant, ``alli``,
``bli``, ``fulli`` and ``logi``) and a few irregular words.
"""

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular words and suffix tables.
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed", "sky": "sky",
}
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DOUBLE_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
ADJECTIVE_SUFFIXES = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
BARE_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)

_LONG_TOKEN = re.compile("[a-z0-9]{4,}")


class _Letters(dict):
    """Vowels and ``y`` by code point; all else is a consonant."""

    def __missing__(self, code: int) -> str:
        return "c"


_LETTERS = _Letters({**{ord(letter): "v" for letter in "aeiou"}, ord("y"): "y"})


def _shape(word: str) -> str:
    """The word as consonants ``c`` and vowels ``v``; ``y`` after a consonant is a vowel."""
    shape = word.translate(_LETTERS)
    while (at := shape.find("y")) >= 0:
        shape = f"{shape[:at]}{'v' if at and shape[at - 1] == 'c' else 'c'}{shape[at + 1:]}"
    return shape


def _measure(word: str) -> int:
    """Runs of vowels that consonants follow."""
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant (last not w, x, y), or is vowel-consonant."""
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _by_end(table) -> dict[str, list[tuple[str, str]]]:
    """Rules by the last letter of their suffix, each list in the order of the table."""
    found: dict[str, list[tuple[str, str]]] = {}
    for suffix, new in table:
        found.setdefault(suffix[-1], []).append((suffix, new))
    return found


_PLURALS, _DOUBLE, _ADJECTIVE = map(_by_end, (PLURALS, DOUBLE_SUFFIXES, ADJECTIVE_SUFFIXES))
_BARE = _by_end([(suffix, "") for suffix in BARE_SUFFIXES])


def _replace(word: str, rules: dict[str, list[tuple[str, str]]], keep) -> str:
    """Apply the first matching rule if its remaining stem satisfies ``keep``."""
    for suffix, new in rules.get(word[-1:], ()):
        if word.endswith(suffix):
            root = word[: len(word) - len(suffix)]
            return root + new if keep(root, suffix) else word
    return word


def _past_forms(word: str) -> str:
    if not word.endswith(("ed", "ing")):
        return word
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        root = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(root):
            break
    else:
        return word
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if len(root) > 1 and root[-1] == root[-2] and _shape(root)[-1] == "c":
        return root if root[-1] in "lsz" else root[:-1]
    return root + "e" if _measure(root) == 1 and _short_end(root) else root


def _double(word: str) -> str:
    while word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    # The l of -logi counts as part of the stem.
    return _replace(word, _DOUBLE, lambda root, s: _measure(root + "l" if s == "logi" else root) > 0)


def _bare(word: str) -> str:
    # Of -ement, -ment and -ent the longest that matches decides.
    return _replace(word, _BARE, lambda root, s: _measure(root) > 1 and (s != "ion" or root[-1:] in ("s", "t")))


def _final_e(word: str) -> str:
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short_end(root)):
            word = root
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 18)
def porter(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = _replace(word, _PLURALS, lambda root, s: True)
    word = _past_forms(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _double(word)
    word = _replace(word, _ADJECTIVE, lambda root, s: _measure(root) > 0)
    return _final_e(_bare(word))


def stem_token(token: str) -> str:
    """Tokens of up to three characters stay as they are."""
    return porter(token) if len(token) > 3 else token


class _Stems(dict):
    """Stems of a worker's tokens; emptied when full, as rare tokens would fill it for good."""

    def __missing__(self, token: str) -> str:
        if len(self) >= 1 << 17:
            self.clear()
        self[token] = stem = stem_token(token)
        return stem


_STEMS = _Stems()


def stemmed_words(text: str) -> list[str]:
    """The stems of a normalized text's tokens."""
    return list(map(_STEMS.__getitem__, text.split()))


def stem_tokens(text: str) -> str:
    """Stem the tokens longer than three characters, leave separators alone."""
    return _LONG_TOKEN.sub(lambda m: porter(m.group()), text)


@F.arrow_udf(T.StringType())
def stem_text(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else stem_tokens(t) for t in text.to_pylist()], pa.string())
