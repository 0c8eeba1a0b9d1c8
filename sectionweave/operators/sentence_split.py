"""Sentence boundaries from statistics of the corpus itself, without labels (Kiss and Strunk 2006).

A word that nearly always has a period behind it is an abbreviation, which a log-likelihood ratio over its counts
tells; its period ends a sentence only if the next word is one that opens sentences: it follows sure ends far more
often than chance, or it has a capital nowhere else. A number's period ends no sentence before a small letter.
Counting is one pass over the texts with partial sums. Applying it is an expression on each text while the two
word lists are small, and a join of the doubtful periods alone when they are not.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, let, non_empty
from ..session import fits_broadcast, stored

#: Fixed values of the method: the chance of a period behind an abbreviation, and the least ratios.
SURE, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
#: Marks around a token that belong to no word, and those behind a word.
OPENING, CLOSING, BEHIND = "\"'([{", "\"')]}", ".!?,;:"
#: The characters of SPACE.
SPACES = "".join(c for c in map(chr, [*range(0x3001)]) if re.match(SPACE, c))
ENDS = r"""[.!?]["')\]}]*"""
NUMBER = "#"
#: What the word lists decide about a doubtful period: its word, the next one, and whether that has a capital.
ASKED = "struct<word:string,next_word:string,capital:boolean>"
#: Words of each list that become constants of an expression.
MAX_WORDS = 20_000


def _core(token: Column) -> Column:
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def _between(text: Column, low: str, high: str) -> Column:
    """Whether the first character lies in a range of ASCII: this spares most words the patterns below."""
    return let(F.substring(text, 1, 1), lambda c: (c >= low) & (c <= high))


def _word(core: Column) -> Column:
    """The word of a token without marks around it; all numbers are one word, and a token without letters or digits none."""
    return let(F.rtrim(F.lower(core), F.lit(BEHIND)), lambda w: F.when(_between(w, "a", "z"), w)
               .when(w.rlike("^[0-9][0-9.,]*$"), NUMBER).when(w.rlike(r"[\p{L}\p{N}]"), w))


def _parts(token: Column) -> Column:
    return let(_core(token), lambda c: F.struct(c.alias("core"), _word(c).alias("word")))


def _capital(core: Column) -> Column:
    return F.when(_between(core, "a", "z"), False).otherwise(core.rlike(r"^\p{Lu}"))


def _small(core: Column) -> Column:
    return core.rlike(r"^\p{Ll}")


def _single_letter(word: Column) -> Column:
    return (F.char_length(word) == 1) & word.rlike(r"^\p{L}$")


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """How often each word stands with and without a period, with and without a capital, by what stands before it.

    ``after`` is null inside a sentence, empty at the beginning of a text, ``!`` behind an exclamation or question
    mark, else the word whose period stands before. Null texts have no words.
    """
    # Only the first token of a run has a mark before it, so runs are listed with the token before them, and tokens as they are.
    runs = let(_runs(F.ltrim(F.col(column), F.lit(SPACES))), lambda all_: F.transform(
        all_, lambda run, i: F.struct(run.alias("run"), F.when(i == 0, "").otherwise(_tail(F.get(all_, i - 1))).alias("before"))))
    tokens = texts.select(F.explode(runs).alias("r")).select("r.before", F.posexplode(F.split("r.run", f"{SPACE}+")).alias("at", "token"))
    # Tokens repeat: they are counted as they stand, and only distinct ones are taken apart.
    distinct = tokens.where("token <> ''").groupBy("token", F.when(F.col("at") == 0, F.col("before")).alias("before")).agg(F.count("*").alias("n"))
    # Behind a generator each expression is evaluated once a row, however often its column is used.
    taken = F.struct(_parts(F.col("token")).alias("own"), F.when(F.col("before") != "", _parts(F.col("before"))).alias("last"))
    parts = distinct.select("n", "before", F.inline(F.array(taken)))
    core, last = F.col("own.core"), F.col("last.core")
    facts = F.struct(core.endswith(".").alias("period"), _capital(core).alias("capital"), F.col("own.word").alias("word"),
                     F.when(F.col("before") == "", "").when(last.endswith("!") | last.endswith("?"), "!")
                     .when(last.endswith("."), F.coalesce("last.word", F.lit("."))).alias("after"))
    rows = parts.select("n", F.inline(F.array(facts)))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return rows.where("word IS NOT NULL").groupBy("word", "after").agg(
        count(F.col("period")).alias("n_period"), count(~F.col("period")).alias("n_plain"),
        count(F.col("capital")).alias("n_capital"), count(~F.col("capital")).alias("n_small"))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log likelihood of ``k`` in ``n`` at chance ``p``; 0 log 0 is 0."""
    return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)


def learn(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per word: its counts, the two ratios, and whether it is an ``abbreviation`` or ``opens`` sentences.

    ``n_met`` says how often a word stands with a capital behind a doubtful period of this corpus. An empty corpus
    gives no rows.
    """
    counts = stored(word_counts(texts, column), "word_counts")
    total = counts.agg(F.sum("n_period").alias("p"), F.sum(F.col("n_period") + F.col("n_plain")).alias("n")).first()
    if not total.n:
        rate = 0.5
    else:
        rate = min(max(total.p / total.n, 1e-12), 1 - 1e-12)
    inside = F.col("after").isNull()
    words = counts.groupBy("word").agg(
        F.sum("n_period").alias("n_period"), F.sum("n_plain").alias("n_plain"), F.sum("n_small").alias("n_small"),
        F.sum(F.when(inside, F.col("n_capital")).otherwise(0)).alias("n_capital_inside"))
    k, n = F.col("n_period"), F.col("n_period") + F.col("n_plain")
    letters = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    ratio = 2 * (_likelihood(k, n, F.lit(SURE)) - _likelihood(k, n, F.lit(rate)))
    scaled = ratio * F.exp(-letters) * (F.char_length("word") - letters + 1) * F.pow(letters, -F.col("n_plain"))
    words = words.withColumn("ratio", scaled).withColumn(
        "abbreviation", (k > 0) & (F.col("ratio") >= ABBREVIATION) & (F.col("word") != NUMBER))
    words = stored(words, "words")
    # What stands behind a sure end, and behind a doubtful period.
    doubtful = words.where(F.col("abbreviation") | (F.col("word") == NUMBER) | _single_letter(F.col("word"))).select(
        F.col("word").alias("after"), (F.col("word") != NUMBER).alias("doubt"))
    behind = counts.where("after <> ''").join(doubtful, "after", "left")
    # A period without a word before it, such as an ellipsis, is a sure end as well.
    sure = F.col("doubt").isNull()
    ends = stored(behind.groupBy("word").agg(
        F.sum(F.when(sure, F.col("n_period") + F.col("n_plain")).otherwise(0)).alias("n_first"),
        F.sum(F.when(F.col("doubt"), F.col("n_capital")).otherwise(0)).alias("n_met")), "ends")
    n_ends = ends.agg(F.sum("n_first")).first()[0] or 0
    both, mine = F.col("n_first"), F.col("n_period") + F.col("n_plain")
    chance = mine / F.lit(total.n or 1)
    first = both / F.lit(n_ends) if n_ends else F.lit(0.0)
    elsewhere = (mine - both) / F.lit(total.n - n_ends) if total.n and total.n > n_ends else F.lit(0.0)
    gain = 2 * (_likelihood(both, F.lit(n_ends), first) + _likelihood(mine - both, F.lit((total.n or 0) - n_ends), elsewhere)
                - _likelihood(both, F.lit(n_ends), chance) - _likelihood(mine - both, F.lit((total.n or 0) - n_ends), chance))
    return words.join(ends, "word", "left").select(
        "word", "n_period", "n_plain", "ratio", "abbreviation", F.coalesce(both, F.lit(0)).alias("n_first"),
        F.when((both > 0) & (first > elsewhere), gain).otherwise(0.0).alias("starts"),
        F.coalesce("n_met", F.lit(0)).alias("n_met"),
        (((F.col("starts") >= STARTER) & (F.col("word") != NUMBER)) | ((F.col("n_small") > 0) & (F.col("n_capital_inside") == 0))).alias("opens"))


def _runs(text: Column) -> Column:
    """The text in runs that end behind a mark and white space, where a sentence may end."""
    return F.regexp_extract_all(text, F.lit(f"(?s).*?{ENDS}{SPACE}+|.+$"), F.lit(0))


def _tail(run: Column) -> Column:
    """The last token of a run."""
    short = F.substring_index(F.substring_index(F.rtrim(run, F.lit(SPACES)), " ", -1), "\n", -1)
    return let(short, lambda t: F.when(t.rlike(SPACE), F.regexp_extract(t, f"[^{SPACE[1:-1]}]+$", 0)).otherwise(t))


def _first(run: Column) -> Column:
    """The first token, without marks around it, of a run behind another one: it begins with a token."""
    short = F.substring_index(F.substring_index(run, " ", 1), "\n", 1)
    return _core(let(short, lambda t: F.when(t.rlike(SPACE), F.regexp_extract(t, f"^[^{SPACE[1:-1]}]*", 0)).otherwise(t)))


def _broken(run: Column) -> Column:
    return F.concat(F.rtrim(run, F.lit(SPACES)), F.lit("\n"))


def _decided(last: Column, word: Column, following: Column) -> Column:
    """True or false where the two tokens alone decide; null behind a period that needs the lists."""
    return F.when(~last.endswith(".") | word.isNull(), True).when(word == NUMBER, ~_small(following))


def _lines_by_lists(text: Column, abbreviations: list[str], openers: list[str]) -> Column:
    def ends(last: Column, following: Column) -> Column:
        def judged(word: Column) -> Column:
            doubtful = _single_letter(word) | (word.isin(abbreviations) if abbreviations else F.lit(False))
            opens = _capital(following) & (_word(following).isin(openers) if openers else F.lit(False))
            return F.coalesce(_decided(last, word, following), ~doubtful | F.coalesce(opens, F.lit(False)))

        return F.when(~last.endswith("."), True).otherwise(let(_word(last), judged))

    def line(runs: Column) -> Column:
        return F.array_join(F.transform(runs, lambda run, i: F.when(
            (i < F.size(runs) - 1) & let(_core(_tail(run)), lambda last: ends(last, _first(F.get(runs, i + 1)))), _broken(run)).otherwise(run)), "")

    return F.when(text.isNotNull(), let(_runs(text), line))


def _asked(df: DataFrame, column: str) -> DataFrame:
    """Texts in ``segments`` that end at doubtful periods, already broken where the tokens alone decide, and what is ``asked`` about each such period."""
    def judged(runs: Column) -> Column:
        def told(run: Column, i: Column) -> Column:
            last, following = _core(_tail(run)), F.when(i < F.size(runs) - 1, _first(F.get(runs, i + 1)))
            return let(F.struct(last.alias("last"), following.alias("following")), lambda t: F.when(t["following"].isNull(), F.struct(
                run.alias("line"), F.lit(None).cast(ASKED).alias("ask"))).otherwise(F.when(~t["last"].endswith("."), F.struct(
                    _broken(run).alias("line"), F.lit(None).cast(ASKED).alias("ask"))).otherwise(let(_word(t["last"]), lambda word: let(
                        _decided(t["last"], word, t["following"]), lambda ends: F.struct(
                            F.when(ends, _broken(run)).otherwise(run).alias("line"),
                            F.when(ends.isNull(), F.struct(word.alias("word"), _word(t["following"]).alias("next_word"), _capital(t["following"]).alias("capital"))).alias("ask")))))))

        return F.transform(runs, told)

    def cut(lines: Column) -> Column:
        """Runs up to and with each doubtful one are one segment."""
        places = F.filter(F.transform(lines, lambda line, i: F.when(line["ask"].isNotNull(), i)), lambda i: i.isNotNull())
        return let(places, lambda at: F.struct(
            F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: let(F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), lambda begin: F.array_join(
                F.transform(F.slice(lines, begin + 1, F.coalesce(F.get(at, k) + 1, F.size(lines)) - begin), lambda line: line["line"]), ""))).alias("segments"),
            F.transform(at, lambda i: F.get(lines, i)["ask"]).alias("asked")))

    return df.withColumn("split_parts", F.when(F.col(column).isNotNull(), let(_runs(F.col(column)), lambda runs: let(judged(runs), cut))))


def _lines_by_join(df: DataFrame, column: str, words: DataFrame, out: str) -> DataFrame:
    """Only what is asked about doubtful periods is joined with the words, and only the places of those that end no sentence come back.

    Each text is taken apart once; its segments wait in a stored table, under a digest. Equal texts have equal places, which partial sets fold.
    """
    key = "text_digest"
    parts = _asked(df.withColumn(key, F.sha2(F.col(column), 256)), column)
    parts = stored(parts.drop(column) if out == column else parts, "split_parts")
    each = parts.select(key, F.posexplode_outer("split_parts.asked").alias("place", "ask")).where("ask IS NOT NULL").select(key, "place", "ask.*")
    short = words.where("abbreviation").select("word", F.lit(True).alias("short"))
    opens = words.where("opens").select(F.col("word").alias("next_word"), F.lit(True).alias("opens"))
    doubtful = each.join(short, "word", "left").where(F.col("short").isNotNull() | _single_letter(F.col("word")))
    within = doubtful.join(opens, "next_word", "left").where(~(F.col("capital") & F.coalesce("opens", F.lit(False))))
    places = within.groupBy(key).agg(F.array_sort(F.collect_set("place")).alias("split_within"))
    segments, at = F.col("split_parts.segments"), F.coalesce("split_within", F.array().cast("array<int>"))

    def line(begin: Column, end: Column) -> Column:
        """Segments up to one behind which the line goes on."""
        return F.concat(F.array_join(F.transform(F.slice(segments, begin + 1, end - begin), _broken), ""), F.get(segments, end))

    whole = let(at, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: line(
        F.coalesce(F.get(p, k - 1) + 1, F.lit(0)), F.coalesce(F.get(p, k), F.size(segments) - 1))), ""))
    return parts.join(places, key, "left").withColumn("split_lines", F.when(F.col("split_parts").isNotNull(), whole)).select(
        *(F.col("split_lines").alias(c) if c == out else F.col(c) for c in [*df.columns, *([] if out in df.columns else [out])]))


def split_lines(df: DataFrame, words: DataFrame, column: str = "text", out: str | None = None, own: bool = False,
                max_words: int = MAX_WORDS) -> DataFrame:
    """``out`` (``column`` by default) with each sentence of ``column`` on its own line; other white space stays.

    ``words`` is what :func:`learn` gives; if it learnt from these very texts (``own``), only the openers that it met
    behind doubtful periods are needed, which are few. Its abbreviations and openers become constants of an expression when
    there are at most ``max_words`` of each, and are joined otherwise; both ways agree. Null stays null.
    """
    out = out or column
    words = words.withColumn("opens", F.col("opens") & (F.col("n_met") > 0)) if own else words
    lists = [words.where("abbreviation").select("word"), words.where("opens").select("word")]
    if all(fits_broadcast(which, max_words) for which in lists):
        short, opens = ([r.word for r in which.collect()] for which in lists)  # checked: at most max_words
        return df.withColumn(out, _lines_by_lists(F.col(column), short, opens))
    return _lines_by_join(df, column, words, out)
