"""Quality rules as a ledger of failure bits, with DataFrame expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each rule that
fails; a policy is a set of rules, so another policy, or leaving a rule out, needs the ledger alone.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
EXCLAIMED = "!?"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
WINDOW = 5

#: Rules in the order of their bits: name and the condition that fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("exclaimed", "100 * n_exclaimed > 50 * n_words"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules of which none may fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "exclaimed"),
    "v2": tuple(BITS),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that is found twice or more; windows are compared by 64-bit hash.

    Most texts repeat no window, which one hash set shows; only the others sort theirs.
    """
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(found: Column) -> Column:
        same = lambda w, i, j: F.coalesce(F.get(found, j)["h"] == w["h"], F.lit(False))
        twice = F.filter(found, lambda w, i: same(w, i, i + 1) | ((i > 0) & same(w, i, i - 1)))
        return _let(F.sort_array(F.transform(twice, lambda w: w["at"])), covered)

    def counted(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(placed, repeated))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(grams, counted))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document; a null text has no words. Other columns are not read."""
    def less(chars: str) -> Column:
        return F.char_length("text") - F.char_length(F.translate("text", chars, ""))

    words = F.array_remove(F.split("text", f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select(
            "doc_id",
            _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat"))).alias("words"),
            _let(lines, lambda l: F.struct(F.size(l).alias("n"), (F.size(l) - F.size(F.array_distinct(l))).alias("dup"))).alias("lines"),
            F.char_length(F.translate("text", SPACE, "")).alias("word_chars"),
            less(SYMBOLS).alias("n_symbols"), less(EXCLAIMED).alias("n_exclaimed"), less(UPPER).alias("n_upper"))
        .select("doc_id", *(F.expr(e).cast("long").alias(n) for n, e in (
            ("n_words", "words.n"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_lines", "lines.n"),
            ("n_dup_lines", "lines.dup"), ("n_repeat_words", "words.repeat"), ("n_exclaimed", "n_exclaimed"), ("n_upper", "n_upper"))))
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = sum((F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(RULES)),
               F.lit(0).cast("long"))
    return measured(docs).withColumn("fail_bits", bits)


def passes(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: the policy holds, and so do the base rules."""
    return ledger(docs).withColumns({
        "base_failed": ~passes(F.col("fail_bits"), "base"),
        "kept": passes(F.col("fail_bits"), "base") & passes(F.col("fail_bits"), policy)})


def filter_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all their columns as they are; a projection, no join."""
    packed = docs.select(F.struct("*").alias("doc_id"), "text")
    return verdicts(packed, policy).where("kept").select("doc_id.*")


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents it rejects, those that it alone rejects, and those kept without it.

    Entries of the ledger fold to one count for each set of failures, of which there are few; what follows reads these.
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    whole = mask(policy)
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit"))
                                for name in POLICIES[policy])))
    held = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    where = lambda found: F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias
    return (counts.select("n", held.alias("held"), rules.alias("r")).select("n", "held", "r.rule", "r.bit")
            .groupBy("rule").agg(
                where(F.col("held").bitwiseAND(F.col("bit")) != 0)("rejected"),
                where(F.col("held") == F.col("bit"))("rejected_alone"),
                where((F.col("held") == 0) | (F.col("held") == F.col("bit")))("kept_without")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
grams AS (SELECT doc_id, i, words[i:i + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
twice AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM grams GROUP BY doc_id, gram HAVING count(*) > 1)),
steps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM twice),
repeats AS (SELECT doc_id, sum(step) AS n FROM steps GROUP BY doc_id),
m AS (
SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
       length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
       length(text) - length(translate(text, '!?', '')) AS n_exclaimed,
       length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', '')) AS n_upper
FROM t LEFT JOIN repeats USING (doc_id)),
b AS (
SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT)
       + 4 * CAST(100 * n_symbols > 30 * n_words AS BIGINT) + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT)
       + 16 * CAST(100 * n_exclaimed > 50 * n_words AS BIGINT) + 32 * CAST(100 * n_upper > 50 * word_chars AS BIGINT)
       + 64 * CAST(word_chars < 2 * n_words AS BIGINT) + 128 * CAST(word_chars > 12 * n_words AS BIGINT) AS fail_bits
FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept
FROM b
"""
