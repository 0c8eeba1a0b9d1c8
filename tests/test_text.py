import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sectionweave import oracle
from sectionweave.functions import register_functions, stem, text
from sectionweave.functions.overlap import multiset_overlap, ngrams
from sectionweave.functions.sections import identify_section
from sectionweave.functions.stem import porter, stem_text, stem_token


def evaluate(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


@pytest.mark.parametrize("header, code", [
    ("Introduction", "i"), ("MATERIALS AND METHODS", "m"), ("Results and Discussion", "r"),
    ("background/aims", "i"), ("Limitations", "d"), ("Findings", "l"), ("Summary", "i"), ("Appendix A", "o"),
    ("  concluding\tremarks ", "c"), ("introduction:", "o"), ("", "o"), (None, "o"),
])
def test_header_types(spark, header, code):
    assert evaluate(spark, identify_section, header) == [code]


def test_markers_leave_their_spaces(spark):
    # k sentences of W words in all: W + 2k pieces after the markers are gone.
    stripped = evaluate(spark, lambda c: text.strip_markers(c), "<S> a b </S> <S> c d </S>")
    assert stripped == [" a b   c d "]
    assert evaluate(spark, text.piece_count, *stripped) == [8]
    assert evaluate(spark, text.piece_count, "") == [1]
    assert evaluate(spark, text.strip_markers, "<s> a </s>") == ["<s> a </s>"]


def test_scoring_tokens(spark):
    rows = evaluate(spark, text.rouge_tokens, "It's 3-D, naïve!", " ... ", "<S> a </S>", None)
    assert rows == [["it", "s", "3", "d", "na", "ve"], [], ["s", "a", "s"], None]
    assert evaluate(spark, lambda c: text.token_count(text.normalize(c)), "It's 3-D", "...", "one") == [4, 0, 1]


def test_text_clean_up(spark):
    assert evaluate(spark, text.postprocess_text, "\t A b. C d!  E?f g \n") == ["A b.\nC d!\nE?f g"]
    assert evaluate(spark, text.export_text, "a\nb<n>c <N>") == ["a bc <N>"]


def test_ngrams_and_overlap(spark):
    df = spark.createDataFrame([("a b a c", "a a b a"), ("a", ""), ("", "")], "x string, y string")
    tokens = [text.normalized_tokens(F.col(c)) for c in "xy"]
    rows = df.select(multiset_overlap(*tokens), ngrams(tokens[0], 2), ngrams(tokens[1], 2),
                     multiset_overlap(*(ngrams(t, 2) for t in tokens))).collect()
    assert [tuple(r) for r in rows] == [
        (3, ["a b", "b a", "a c"], ["a a", "a b", "b a"], 2), (0, [], [], 0), (0, [], [], 0)]


PORTER = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz
failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil dies die flies fli spied spi died die
dying die skies sky geology geolog enjoy enjoy boy boy""".split()


def test_porter_examples():
    assert [porter(w) for w in PORTER[::2]] == PORTER[1::2]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT lcs_len('a b c', 'a x c') AS n, stem_text('running') AS s, section_lcs('a b\n', 'b\n\f') AS t").first()
    assert (row.n, row.s, row.t) == (2, "run", [[1]])


def test_stemming_keeps_separators_and_short_tokens(spark):
    assert evaluate(spark, stem_text, "the ties was\nrunning\fflies", None) == ["the tie was\nrun\ffli", None]


def test_white_space_of_any_script(spark):
    df = spark.createDataFrame([("1\u00a0Introduction",), ("\u2003Results\u3000",)], "x string")
    assert [r[0] for r in df.select(identify_section(F.col("x"))).collect()] == ["i", "r"]
    assert [r[0] for r in df.select(text.strip(F.col("x"))).collect()] == ["1\u00a0Introduction", "Results"]
    assert spark.range(1).select(text.postprocess_text(F.lit("\u2003a.\u00a0b!\u3000c "))).first()[0] == "a.\nb!\nc"


def test_stems_in_sql_are_those_of_the_library():
    """Two writings of one algorithm, over words made of many endings."""
    rng = random.Random(3)
    endings = [ending for step in (oracle.STEP_1A, oracle.STEP_1B, oracle.STEP_2, oracle.STEP_3, oracle.STEP_4) for ending, _ in step] + ["y", "e", "ll"]
    words = {"".join(rng.choices("aeiouybcdlstwxz", k=rng.randint(0, 5))) + "".join(rng.choices(endings, k=rng.randint(1, 3))) for _ in range(20_000)}
    words |= {word for word, _ in oracle.IRREGULAR} | {"caresses", "ponies", "ties", "relational", "hopping", "controlling", "2nd", "1990s"}
    given = pa.table({"w": sorted(words)})
    got = dict(duckdb.connect().execute(f"WITH {oracle._stems('given')} SELECT w, x FROM stems").fetchall())
    assert given.num_rows > 10_000 and {w: got.get(w, w) for w in words} == {w: stem_token(w) for w in words}


def test_shapes_and_cached_stems():
    def shape(word):
        found = ""
        for letter in word:
            found += "v" if letter in "aeiou" or (letter == "y" and found.endswith("c")) else "c"
        return found

    rng = random.Random(2)
    words = ["".join(rng.choices("aeyybcd9é", k=rng.randint(1, 9))) for _ in range(2000)]
    assert [stem._shape(w) for w in words] == [shape(w) for w in words]
    assert stem.stemmed_words("national  flies agreed the national") == "nation fli agre the nation".split()


def test_rules_are_tried_by_last_letter_only(monkeypatch):
    tried = []

    class Word(str):
        def endswith(self, suffix):
            tried.append(suffix)
            return str.endswith(self, suffix)

    stem._replace(Word("stemmed"), stem._BARE, lambda root, s: True)
    assert not tried
