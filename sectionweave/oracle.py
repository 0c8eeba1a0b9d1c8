"""SQL for DuckDB that computes the registered queries independently.

LCS lengths come from a different method than the library's: matching token
positions, sorted, are reduced to a longest increasing run of positions.
"""

# Fixed values, spelt out here so that a wrong one in the library shows.
PAD, UNK, IGNORED_LABEL = 0, 1, -100
MAX_SOURCE, MAX_TARGET, HEAD, REPS = 512, 128, 100, 1000
TRAINING_TYPES = ("i", "m", "r", "l", "c")
SCORING_TYPES = ("i", "m", "r", "c")
KEYWORDS = {
    "introduction": "i", "case": "i", "purpose": "i", "objective": "i", "objectives": "i", "aim": "i",
    "summary": "i", "findings": "l", "background": "i", "background/aims": "i", "literature": "l",
    "studies": "l", "related": "l", "methods": "m", "method": "m", "techniques": "m", "methodology": "m",
    "results": "r", "result": "r", "experiment": "r", "experiments": "r", "experimental": "r",
    "discussion": "c", "limitations": "d", "conclusion": "c", "conclusions": "c", "concluding": "c",
}
# P(X <= k) of a Poisson variable with mean 1, k from 0, times 2^32.
POISSON_STEPS = (
    1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292,
    4294609778, 4294923276, 4294962463, 4294966817, 4294967253, 4294967292,
)

NL = "chr(10)"
# White space of any script.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _tokens(text: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            "lambda t: t <> '')")


def _sentences(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?]){SPACE}+', '\1' || {NL}, 'g'), {NL})"


def _pieces(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda t: t <> '')"


def _longest_run(positions: str) -> str:
    """Length of the longest strictly increasing subsequence of a list of positions."""
    return (f"len(list_reduce(list_transform({positions}, lambda p: [p]), "
            "lambda run, e: list_concat(list_concat(list_filter(run, lambda y: y < e[1]), e), "
            "list_filter(run, lambda y: y >= e[1])[2:]), []::BIGINT[]))")


def _contains(whole: str, part: str) -> str:
    """Whether a token list holds another as one unbroken run; its LCS is then the part itself."""
    return f"contains(' ' || array_to_string({whole}, ' ') || ' ', ' ' || array_to_string({part}, ' ') || ' ')"


def _types(codes) -> str:
    return ", ".join(f"'{c}'" for c in codes)


# Documents as articles: lines, sentences with their section, abstract sentences.
ARTICLES = f"""
raw_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, {NL})) AS line,
         generate_subscripts(string_split(text, {NL}), 1) AS p
  FROM documents),
lines AS (
  SELECT doc_id, lang, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM raw_lines WHERE trim(line, ' ') <> ''),
split_lines AS (SELECT doc_id, lang, i, (i * 6) // n AS sec, {_sentences('line')} AS ss FROM lines),
sentences AS (
  SELECT doc_id, i, sec, unnest(ss) AS s, generate_subscripts(ss, 1) AS j FROM split_lines),
abstract AS (
  SELECT doc_id, i AS m, '<S> ' || CASE WHEN len(ss) = 1 THEN ss[1] ELSE ss[1] || ' ' || ss[-1] END || ' </S>' AS s
  FROM split_lines),
section AS (
  SELECT doc_id, lang, sec, CASE sec WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Related Work'
    WHEN 2 THEN 'Materials and Methods' WHEN 3 THEN 'RESULTS' WHEN 4 THEN 'Discussion and Conclusions'
    ELSE CASE WHEN lang = 'en' THEN 'Limitations' ELSE 'Appendix A' END END AS head
  FROM documents, range(6) r(sec)),
section_text AS (
  SELECT doc_id, sec, string_agg(s, ' ' ORDER BY i, j) AS document, count(*) AS n_sentences
  FROM sentences GROUP BY ALL)"""

# Fixed values of Porter (1980) with the usual extensions: ending, what takes its place; the first that fits counts.
IRREGULAR = (
    ("sky", "sky"), ("skies", "sky"), ("dying", "die"), ("lying", "lie"), ("tying", "tie"), ("news", "news"),
    ("inning", "inning"), ("innings", "inning"), ("outing", "outing"), ("outings", "outing"),
    ("canning", "canning"), ("cannings", "canning"), ("howe", "howe"),
    ("proceed", "proceed"), ("exceed", "exceed"), ("succeed", "succeed"),
)
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_1B = (("ied", ""), ("eed", ""), ("ed", ""), ("ing", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = tuple((ending, "") for ending in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize"))


def _shape(word: str) -> str:
    """Vowels as v, other letters as c; a y is a vowel behind a consonant."""
    return (f"CASE WHEN {word} = '' THEN '' ELSE list_reduce(string_split({word}, ''), lambda s, x: s || "
            "CASE WHEN contains('aeiou', x) OR (x = 'y' AND s[-1:] = 'c') THEN 'v' ELSE 'c' END, '') END")


def _measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'v+c+'))"


def _short(word: str, shape: str) -> str:
    return f"({shape} = 'vc' OR (suffix({shape}, 'cvc') AND NOT contains('wxy', {word}[-1:])))"


def _ending(name: str, source: str, rules, becomes: str) -> str:
    """``becomes`` over root, shape, ending, new and x for words x with one of the endings; other words stay."""
    rows = ", ".join(f"({i}, '{ending}', '{new}')" for i, (ending, new) in enumerate(rules))
    return f"""
{name}_roots AS (
  SELECT w, x, ending, new, left(x, length(x) - length(ending)) AS root
  FROM {source} JOIN (VALUES {rows}) r(place, ending, new) ON suffix(x, ending)
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY place) = 1),
{name}_shapes AS (SELECT *, {_shape('root')} AS shape FROM {name}_roots),
{name} AS (
  SELECT w, x FROM {source} ANTI JOIN {name}_roots USING (w)
  UNION ALL SELECT w, {becomes} FROM {name}_shapes)"""


def _stems(words: str) -> str:
    """CTE ``stems`` (w, x) of the tokens w of ``words`` that are longer than three characters."""
    past = f"""CASE ending WHEN 'ied' THEN root || CASE WHEN length(x) = 4 THEN 'ie' ELSE 'i' END
    WHEN 'eed' THEN CASE WHEN {_measure('shape')} > 0 THEN root || 'ee' ELSE x END
    ELSE CASE WHEN NOT contains(shape, 'v') THEN x WHEN regexp_matches(root, '(at|bl|iz)$') THEN root || 'e'
      WHEN length(root) > 1 AND root[-1:] = root[-2:-2] AND shape[-1:] = 'c'
        THEN CASE WHEN contains('lsz', root[-1:]) THEN root ELSE root[:-2] END
      WHEN {_measure('shape')} = 1 AND {_short('root', 'shape')} THEN root || 'e' ELSE root END END"""
    kept = "CASE WHEN {} THEN root || new ELSE x END".format
    long = f"{_measure('shape')} > 0"
    return f"""
long_words AS (SELECT DISTINCT w, w AS x FROM {words} WHERE length(w) > 3),
{_ending('plain', 'long_words', STEP_1A, "CASE WHEN length(x) = 4 AND ending = 'ies' THEN x[:-2] ELSE root || new END")},
{_ending('past', 'plain', STEP_1B, past)},
{_ending('ypsilon', 'past', (('y', 'i'),), kept("length(x) > 2 AND shape[-1:] = 'c'"))},
{_ending('ally', 'ypsilon', (('alli', 'al'),), kept(long))},
{_ending('doubled', 'ally', STEP_2, kept(f"{_measure(_shape('(CASE ending WHEN $$logi$$ THEN root || $$l$$ ELSE root END)'))} > 0"))},
{_ending('adjectives', 'doubled', STEP_3, kept(long))},
{_ending('bare', 'adjectives', STEP_4, kept(f"{_measure('shape')} > 1 AND (ending <> 'ion' OR root[-1:] IN ('s', 't'))"))},
{_ending('final_e', 'bare', (('e', ''),), kept(f"{_measure('shape')} > 1 OR ({_measure('shape')} = 1 AND NOT {_short('root', 'shape')})"))},
{_ending('final_l', 'final_e', (('ll', 'l'),), kept(f"{_measure(_shape('(root || new)'))} > 1"))},
stems AS (
  SELECT w, coalesce(known.x, f.x) AS x
  FROM final_l f LEFT JOIN (VALUES {', '.join(map(str, IRREGULAR))}) known(word, x) ON word = w)"""


def _stemmed_text(name: str, source: str, keys: str) -> str:
    """The texts s of ``source`` as stemmed tokens between spaces; a text without tokens is left out."""
    return f"""
{name} AS (
  SELECT {keys}, string_agg(coalesce(x, w), ' ' ORDER BY pos) AS s FROM (
    SELECT {keys}, line, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos
    FROM (SELECT {keys}, row_number() OVER () AS line, {_tokens('s')} AS toks FROM {source}))
  LEFT JOIN stems USING (w) GROUP BY {keys}, line)"""


# Sentences and abstracts of the articles, stemmed.
ARTICLE_STEMS = f"""
article_words AS (
  SELECT DISTINCT unnest({_tokens('s')}) AS w FROM (SELECT s FROM sentences UNION ALL SELECT s FROM abstract)),
{_stems('article_words')},
{_stemmed_text('stemmed_sentences', 'sentences', 'doc_id, sec')},
{_stemmed_text('stemmed_abstract', 'abstract', 'doc_id, m')}"""

KEYWORD_ROWS = ", ".join(f"('{w}', '{c}')" for w, c in KEYWORDS.items())

TYPES = rf"""
head_words AS (
  SELECT head, unnest(regexp_split_to_array(lower(head), '{SPACE}+')) AS word,
         generate_subscripts(regexp_split_to_array(lower(head), '{SPACE}+'), 1) AS pos
  FROM (SELECT DISTINCT head FROM section)),
head_type AS (
  SELECT head, coalesce(arg_min(code, pos) FILTER (code IS NOT NULL), 'o') AS section_id
  FROM head_words LEFT JOIN (VALUES {KEYWORD_ROWS}) k(word, code) USING (word) GROUP BY head)"""


def _scores(abstract: str = "s", stemmed: str = "") -> str:
    """LCS recall of every abstract sentence with every section."""
    return f"""
abstract_tokens AS (SELECT doc_id, m, {_tokens(abstract)} AS toks FROM {stemmed}abstract),
abstract_words AS (
  SELECT doc_id, m, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM abstract_tokens),
distinct_sentences AS (
  SELECT doc_id, sec, toks, row_number() OVER () AS sid
  FROM (SELECT DISTINCT doc_id, sec, {_tokens('s')} AS toks FROM {stemmed}sentences)),
sentence_words AS (
  SELECT doc_id, sec, sid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM distinct_sentences),
whole_parts AS (
  SELECT a.doc_id, a.m, b.sec, b.sid, len(b.toks) AS hit FROM abstract_tokens a JOIN distinct_sentences b USING (doc_id)
  WHERE {_contains('a.toks', 'b.toks')}),
runs AS (
  SELECT a.doc_id, a.m, b.sec, b.sid, list(a.pos ORDER BY b.pos, a.pos DESC) AS positions
  FROM abstract_words a JOIN sentence_words b ON a.doc_id = b.doc_id AND a.tok = b.tok
  ANTI JOIN whole_parts w ON w.doc_id = a.doc_id AND w.m = a.m AND w.sid = b.sid
  GROUP BY a.doc_id, a.m, b.sec, b.sid),
hits AS (
  SELECT doc_id, m, sec, max(hit) AS hit
  FROM (SELECT doc_id, m, sec, {_longest_run('positions')} AS hit FROM runs
        UNION ALL SELECT doc_id, m, sec, hit FROM whole_parts) GROUP BY doc_id, m, sec),
scores AS (
  SELECT a.doc_id, a.m, r.sec,
         CASE WHEN len(a.toks) = 0 THEN 0 ELSE coalesce(h.hit, 0) / len(a.toks) END::FLOAT AS score
  FROM abstract_tokens a CROSS JOIN range(6) r(sec)
  LEFT JOIN hits h ON h.doc_id = a.doc_id AND h.m = a.m AND h.sec = r.sec),
best AS (
  SELECT doc_id, m, sec, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id, m ORDER BY score DESC, sec) = 1)"""


UNMARKED = "regexp_replace(s, '</?S>', '', 'g')"


def _prepared(summary_rule: str = "true") -> str:
    return f"""
summaries AS (
  SELECT b.doc_id, b.sec, regexp_replace(string_agg(a.s, ' ' ORDER BY a.m), '</?S>', '', 'g') AS summary
  FROM best b JOIN abstract a USING (doc_id, m) GROUP BY ALL),
abstracts AS (
  SELECT doc_id, regexp_replace(string_agg(s, ' ' ORDER BY m), '</?S>', '', 'g') AS abstract
  FROM abstract GROUP BY ALL),
prepared AS (
  SELECT doc_id::VARCHAR AS article_id, sec::INTEGER AS section_idx, section_id, document, summary, abstract,
         CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' ELSE 'test' END AS split
  FROM summaries JOIN abstracts USING (doc_id) JOIN section USING (doc_id, sec)
  JOIN section_text USING (doc_id, sec) JOIN head_type USING (head)
  WHERE section_id IN ({_types(TRAINING_TYPES)}) AND len(string_split(document, ' ')) > 50
    AND ({summary_rule}))"""


LONG_SUMMARY = "len(string_split(summary, ' ')) > 50"
ROWS = f"WITH {ARTICLES}, {TYPES}, {_scores()}, {_prepared()}"

# One language is one article id; documents with equal abstracts pool their sections.
POOLED = f"""
WITH {ARTICLES}, {TYPES}, {_scores()},
abstract_of AS (SELECT doc_id, list(s ORDER BY m) AS whole FROM abstract GROUP BY ALL),
section_lines AS (
  SELECT s.doc_id, s.sec, any_value(s.head) AS head,
         count(t.s) || '[' || coalesce(string_agg(length(t.s) || ':' || t.s, '' ORDER BY i, j), '') || ']' AS body
  FROM section s LEFT JOIN sentences t USING (doc_id, sec) GROUP BY ALL),
body_of AS (
  SELECT doc_id, md5(count(*) || '[' || string_agg(length(head) || ':' || head, '' ORDER BY sec) || ']'
                     || count(*) || '[' || string_agg(body, '' ORDER BY sec) || ']') AS body_key
  FROM section_lines GROUP BY ALL),
copies AS (
  SELECT min(doc_id) AS doc_id, lang, whole, body_key
  FROM documents JOIN abstract_of USING (doc_id) JOIN body_of USING (doc_id) GROUP BY lang, whole, body_key),
pooled_best AS (
  SELECT c.lang, c.whole, s.m, c.doc_id, s.sec FROM scores s JOIN copies c USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.whole, s.m ORDER BY s.score DESC, c.body_key, s.sec) = 1),
summaries AS (
  SELECT b.doc_id, b.sec, regexp_replace(string_agg(a.s, ' ' ORDER BY a.m), '</?S>', '', 'g') AS summary
  FROM pooled_best b JOIN abstract a USING (doc_id, m) GROUP BY ALL),
abstracts AS (
  SELECT doc_id, regexp_replace(string_agg(s, ' ' ORDER BY m), '</?S>', '', 'g') AS abstract
  FROM abstract GROUP BY ALL)
SELECT lang AS article_id, sec::INTEGER AS section_idx, section_id, document, summary, abstract
FROM summaries JOIN abstracts USING (doc_id) JOIN section USING (doc_id, sec)
JOIN section_text USING (doc_id, sec) JOIN head_type USING (head)
WHERE section_id IN ({_types(TRAINING_TYPES)}) AND len(string_split(document, ' ')) > 50"""

# Conversations as pairs.
PAIRS = """
turns AS (
  SELECT conv_id, turn, role, text AS target_sum, lag(text) OVER w AS gen_sum, lag(role) OVER w AS before
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT conv_id || ':' || turn AS article_id, target_sum, gen_sum FROM turns
  WHERE role = 'assistant' AND before = 'user')"""


def _token_lists(source: str) -> str:
    return f"""
toks AS (SELECT article_id, {_tokens('target_sum')} AS ref, {_tokens('gen_sum')} AS cand FROM {source})"""


def _prf(hits: str, cand: str, ref: str) -> str:
    return f"""
    CASE WHEN {cand} > 0 THEN {hits} / {cand} ELSE 0 END AS p,
    CASE WHEN {ref} > 0 THEN {hits} / {ref} ELSE 0 END AS r"""


def _gram_lists(n: int) -> str:
    def grams(words: str) -> str:
        return (f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n} + 2), "
                f"lambda i: array_to_string({words}[i:i + {n - 1}], ' ')) ELSE [] END")
    return f"SELECT article_id, {grams('ref')} AS ref, {grams('cand')} AS cand FROM toks"


def _rouge_n(n: int) -> str:
    """Clipped n-gram overlap by counting grams on both sides."""
    return f"""
grams{n} AS ({_gram_lists(n)}),
overlap{n} AS (
  SELECT article_id, sum(least(a.c, b.c)) AS hits
  FROM (SELECT article_id, g, count(*) AS c FROM (SELECT article_id, unnest(ref) AS g FROM grams{n}) GROUP BY ALL) a
  JOIN (SELECT article_id, g, count(*) AS c FROM (SELECT article_id, unnest(cand) AS g FROM grams{n}) GROUP BY ALL) b
  USING (article_id, g) GROUP BY article_id),
rouge{n} AS (
  SELECT article_id, {_prf('coalesce(hits, 0)', 'len(cand)', 'len(ref)')}
  FROM grams{n} LEFT JOIN overlap{n} USING (article_id))"""


ROUGE_L = f"""
ref_words AS (SELECT article_id, unnest(ref) AS tok, generate_subscripts(ref, 1) AS pos FROM toks),
cand_words AS (SELECT article_id, unnest(cand) AS tok, generate_subscripts(cand, 1) AS pos FROM toks),
whole_pairs AS (
  SELECT article_id, least(len(ref), len(cand)) AS hits FROM toks
  WHERE {_contains('ref', 'cand')} OR {_contains('cand', 'ref')}),
pair_runs AS (
  SELECT a.article_id, list(a.pos ORDER BY b.pos, a.pos DESC) AS positions
  FROM cand_words a JOIN ref_words b ON a.article_id = b.article_id AND a.tok = b.tok
  ANTI JOIN whole_pairs w ON w.article_id = a.article_id GROUP BY a.article_id),
pair_hits AS (
  SELECT article_id, {_longest_run('positions')} AS hits FROM pair_runs UNION ALL SELECT * FROM whole_pairs),
rougeL AS (
  SELECT article_id, {_prf('coalesce(hits, 0)', 'len(cand)', 'len(ref)')}
  FROM toks LEFT JOIN pair_hits USING (article_id))"""

NO_STEMS = "stems AS (SELECT '' AS w, '' AS x WHERE false)"


def _line_lists(source: str, stemmed: bool) -> str:
    """Tokens of every line of both texts, and of the whole texts."""
    words = f"""
pair_words AS (
  SELECT DISTINCT unnest({_tokens('s')}) AS w FROM (SELECT target_sum AS s FROM {source} UNION ALL SELECT gen_sum FROM {source})),
{_stems('pair_words')}"""
    return f"""{words if stemmed else NO_STEMS},
side_lines AS (
  SELECT article_id, side, unnest(ls) AS s, generate_subscripts(ls, 1) AS line
  FROM (SELECT article_id, 'ref' AS side, string_split(target_sum, {NL}) AS ls FROM {source}
        UNION ALL SELECT article_id, 'cand', string_split(gen_sum, {NL}) FROM {source})),
line_toks AS (
  SELECT article_id, side, line, list(coalesce(x, w) ORDER BY pos) AS toks FROM (
    SELECT article_id, side, line, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos
    FROM (SELECT article_id, side, line, {_tokens('s')} AS toks FROM side_lines))
  LEFT JOIN stems USING (w) GROUP BY article_id, side, line),
toks AS (
  SELECT article_id, coalesce(flatten(list(toks ORDER BY line) FILTER (side = 'ref')), []) AS ref,
         coalesce(flatten(list(toks ORDER BY line) FILTER (side = 'cand')), []) AS cand
  FROM {source} LEFT JOIN line_toks USING (article_id) GROUP BY article_id)"""


# The table of LCS lengths of two lines, row by row, and the walk back through it: where the tokens differ, a
# reference token goes if the LCS stays as long without it, else a candidate token.
ROUGE_LSUM = f"""
line_pairs AS MATERIALIZED (
  SELECT a.article_id, a.line AS i, b.line AS j, a.toks AS ref, b.toks AS cand
  FROM line_toks a JOIN line_toks b ON a.article_id = b.article_id AND a.side = 'ref' AND b.side = 'cand'
  WHERE list_has_any(a.toks, b.toks)),
lengths AS (
  SELECT article_id, i, j, 0 AS k, list_transform(range(len(cand) + 1), lambda c: 0) AS sizes FROM line_pairs
  UNION ALL
  SELECT article_id, i, j, k + 1, list_transform(range(1, len(cand) + 2), lambda c: list_max(grown[1:c])) FROM (
    SELECT article_id, i, j, k, cand, list_transform(range(len(cand) + 1), lambda c: CASE
             WHEN c > 0 AND cand[c] = ref[k + 1] THEN sizes[c] + 1 ELSE sizes[c + 1] END::INTEGER) AS grown
    FROM lengths JOIN line_pairs USING (article_id, i, j) WHERE k < len(ref))),
walk AS (
  SELECT article_id, i, j, len(ref) AS r, len(cand) AS c, NULL::BIGINT AS hit FROM line_pairs
  UNION ALL
  SELECT article_id, i, j, r - (same OR shorter)::INT, c - (same OR NOT shorter)::INT, CASE WHEN same THEN r END FROM (
    SELECT article_id, i, j, r, c, ref[r] = cand[c] AS same, now.sizes[c + 1] = less.sizes[c + 1] AS shorter
    FROM walk JOIN line_pairs USING (article_id, i, j)
    JOIN lengths now USING (article_id, i, j) JOIN lengths less USING (article_id, i, j)
    WHERE now.k = r AND less.k = r - 1 AND r > 0 AND c > 0)),
covered AS (
  SELECT article_id, toks[hit] AS w, count(*) AS n
  FROM (SELECT DISTINCT article_id, i AS line, hit FROM walk WHERE hit IS NOT NULL)
  JOIN (SELECT * FROM line_toks WHERE side = 'ref') USING (article_id, line) GROUP BY ALL),
offered AS (
  SELECT article_id, w, count(*) AS n FROM (SELECT article_id, unnest(cand) AS w FROM toks) GROUP BY ALL),
lsum_hits AS (
  SELECT article_id, sum(least(covered.n, offered.n)) AS hits FROM covered JOIN offered USING (article_id, w) GROUP BY article_id),
rougeLsum AS (
  SELECT article_id, {_prf('coalesce(hits, 0)', 'len(cand)', 'len(ref)')}
  FROM toks LEFT JOIN lsum_hits USING (article_id))"""

F = "CASE WHEN {0}p + {0}r > 0 THEN 2 * {0}p * {0}r / ({0}p + {0}r) ELSE 0 END"


def _score_rows(metric: str) -> str:
    return f"""
SELECT article_id, '{metric}' AS metric, round(p, 6) AS precision, round(r, 6) AS recall, round({F.format('')}, 6) AS fmeasure
FROM {metric}"""


FLAT = f"""
flat AS (
  SELECT article_id, replace(replace(target_sum, {NL}, ' '), '<n>', '') AS target_sum,
         replace(replace(gen_sum, {NL}, ' '), '<n>', '') AS gen_sum FROM pairs)"""

# Without line breaks the summary-level LCS is the plain one.
PERCENT = f"""
percent AS (
  SELECT article_id, round({F.format('a.')} * 100, 4) AS rouge1, round({F.format('b.')} * 100, 4) AS rouge2,
         round({F.format('c.')} * 100, 4) AS rougeL, round({F.format('c.')} * 100, 4) AS rougeLsum
  FROM rouge1 a JOIN rouge2 b USING (article_id) JOIN rougeL c USING (article_id))"""

LINES_PERCENT = f"""
percent AS (
  SELECT article_id, round({F.format('a.')} * 100, 4) AS rouge1, round({F.format('b.')} * 100, 4) AS rouge2,
         round({F.format('c.')} * 100, 4) AS rougeL, round({F.format('d.')} * 100, 4) AS rougeLsum
  FROM rouge1 a JOIN rouge2 b USING (article_id) JOIN rougeL c USING (article_id) JOIN rougeLsum d USING (article_id))"""

SUMMARY = """
SELECT 'mean' AS statistic, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2,
       round(avg(rougeLsum), 6) AS rougeLsum FROM percent
UNION ALL
SELECT 'std', round(stddev_samp(rouge1), 6), round(stddev_samp(rouge2), 6), round(stddev_samp(rougeLsum), 6)
FROM percent"""


def _all_scores(source: str) -> str:
    return f"{_token_lists(source)}, {_rouge_n(1)}, {_rouge_n(2)}, {ROUGE_L}, {PERCENT}"


LONGEST = r"""
arg_max_list AS (
  SELECT article_id, section_idx, section_id, abstract,
         string_split(regexp_replace(document, '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), chr(10)) AS ss
  FROM prepared),
generated AS (
  SELECT article_id, section_idx, section_id, abstract,
         ss[list_position(list_transform(ss, lambda s: len(string_split(s, ' '))),
                          list_max(list_transform(ss, lambda s: len(string_split(s, ' ')))))] AS gen_sum
  FROM arg_max_list)"""

ASSEMBLED = f"""
assembled AS (
  SELECT article_id, abstract AS target_sum, string_agg(gen_sum, ' ' ORDER BY section_idx) AS gen_sum
  FROM generated WHERE section_id IN ({_types(SCORING_TYPES)}) GROUP BY article_id, abstract)"""


def _weight(uniform: str) -> str:
    steps = " ".join(f"WHEN {uniform} < {step} THEN {k}" for k, step in enumerate(POISSON_STEPS))
    return f"CASE {steps} ELSE {len(POISSON_STEPS)} END"


def _mixed(name: str, source: str, start: str) -> str:
    """CTEs that take ``start`` of the rows of ``source`` through the 32-bit finalizer of MurmurHash3."""
    def times(factor: int) -> str:
        return f"((h::HUGEINT * {factor}) % 4294967296)::BIGINT"

    return f"""
{name}1 AS (SELECT * EXCLUDE (h), xor(h, h >> 16) AS h FROM (SELECT * EXCLUDE (h), {start} AS h FROM {source})),
{name}2 AS (SELECT * EXCLUDE (h), {times(2246822507)} AS h FROM {name}1),
{name}3 AS (SELECT * EXCLUDE (h), xor(h, h >> 13) AS h FROM {name}2),
{name}4 AS (SELECT * EXCLUDE (h), {times(3266489909)} AS h FROM {name}3),
{name} AS (SELECT * EXCLUDE (h), xor(h, h >> 16) AS h FROM {name}4)"""


def _draws(source: str) -> str:
    """A Poisson(1) weight for every row and replicate; equal rows have a number."""
    spelt = " || ".join(f"length({c}) || ':' || {c}" for c in ("article_id", "target_sum", "gen_sum"))
    return f"""
seeds AS (
  SELECT article_id, ('0x' || substr(digest, 1, 8))::BIGINT AS low, ('0x' || substr(digest, 9, 8))::BIGINT AS high,
         row_number() OVER (PARTITION BY digest) - 1 AS nth
  FROM (SELECT article_id, md5({spelt}) AS digest FROM {source})),
numbered AS (
  SELECT article_id, high, rep, xor(xor(low, (nth * 1663821227) % 4294967296), (rep * 2654435769) % 4294967296) AS h
  FROM seeds, range({REPS}) t(rep)),
{_mixed('once', 'numbered', 'h')},
{_mixed('twice', 'once', 'xor(h, high)')},
draws AS (SELECT article_id, rep, {_weight('h')} AS w FROM twice)"""

CELLS = " UNION ALL ".join(
    f"SELECT article_id, '{m}' AS metric, unnest(['fmeasure', 'recall', 'precision']) AS statistic, "
    f"unnest([{F.format('')}, r, p]) AS x FROM {m}" for m in ("rouge1", "rouge2", "rougeL"))

INTERVALS = f"""
cells AS ({CELLS}),
replicate AS (
  SELECT metric, statistic, rep, sum(w * x) / sum(w) AS x FROM cells JOIN draws USING (article_id) GROUP BY ALL),
points AS (SELECT metric, statistic, avg(x) AS value FROM cells GROUP BY ALL),
intervals AS (
  SELECT metric, statistic, any_value(value) AS value, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi
  FROM replicate JOIN points USING (metric, statistic) GROUP BY ALL)"""

FOUR_CELLS = " UNION ALL ".join(
    f"SELECT article_id, '{m}' AS metric, {F.format('')} AS x FROM {m}" for m in ("rouge1", "rouge2", "rougeL", "rougeLsum"))

# Medians of the replicates in percent.
MIDS = """
replicate AS (
  SELECT metric, rep, sum(w * x) / sum(w) AS x FROM cells JOIN draws USING (article_id) GROUP BY ALL),
mids AS (SELECT metric, round(quantile_cont(x, 0.5) * 100, 4) AS value FROM replicate GROUP BY metric)"""

PAIR_SCORES = f"{PAIRS}, {_token_lists('pairs')}, {_rouge_n(1)}, {_rouge_n(2)}, {ROUGE_L}"


def _bleu_tokens(text: str) -> str:
    for old, new in (("'<skipped>'", "''"), (f"'-' || {NL}", "''"), (NL, "' '"), ("'&quot;'", "'\"'"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        text = f"replace({text}, {old}, {new})"
    text = f"(' ' || {text} || ' ')"
    for pattern, new in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                         (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return _pieces(text)


def _bleu(source: str) -> str:
    """Counts per n-gram order over all pairs of ``source``."""
    orders = "".join(f"""
, {_rouge_n(n).strip()},
sums{n} AS (
  SELECT coalesce((SELECT sum(hits) FROM overlap{n}), 0)::BIGINT AS match{n},
         coalesce(sum(len(cand)), 0)::BIGINT AS total{n} FROM grams{n})""" for n in range(1, 5))
    return f"""
toks AS (SELECT article_id, {_bleu_tokens('target_sum')} AS ref, {_bleu_tokens('gen_sum')} AS cand FROM {source}){orders},
counts AS (
  SELECT coalesce(sum(len(cand)), 0)::BIGINT AS gen_len, coalesce(sum(len(ref)), 0)::BIGINT AS ref_len,
         any_value(sums1.match1) AS match1, any_value(sums2.match2) AS match2, any_value(sums3.match3) AS match3,
         any_value(sums4.match4) AS match4, any_value(total1) AS total1, any_value(total2) AS total2,
         any_value(total3) AS total3, any_value(total4) AS total4
  FROM toks, sums1, sums2, sums3, sums4)"""


def _log_p(n: int) -> str:
    misses = " + ".join(f"(match{k} = 0)::INT" for k in range(1, n + 1))
    return f"ln(CASE WHEN match{n} > 0 THEN 100.0 * match{n} / total{n} ELSE 100.0 / (pow(2, {misses}) * total{n}) END)"


BLEU = f"""CASE WHEN total4 > 0 AND match1 + match2 + match3 + match4 > 0 THEN
  CASE WHEN gen_len < ref_len THEN exp(1 - ref_len / gen_len) ELSE 1 END
  * exp(({' + '.join(_log_p(n) for n in range(1, 5))}) / 4) ELSE 0 END"""

# Words of all turns, numbered in digest order from 2.
VOCAB = f"""
all_words AS (SELECT DISTINCT unnest({_pieces('text')}) AS token FROM conversations),
vocab AS (SELECT token, row_number() OVER (ORDER BY md5(token)) + 1 AS id FROM all_words)"""


def _ids(name: str, text: str, length: int) -> str:
    return f"""
{name}_words AS (
  SELECT article_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
  FROM (SELECT article_id, {_pieces(text)}[1:{length}] AS ws FROM pairs)),
{name} AS (
  SELECT article_id, list(coalesce(id, {UNK}) ORDER BY pos) AS ids
  FROM {name}_words LEFT JOIN vocab USING (token) GROUP BY article_id)"""


def _padded(ids: str, length: int, fill) -> str:
    return f"list_concat({ids}, list_transform(range({length} - len({ids})), lambda i: {fill}))"


ENCODED = f"""
{VOCAB}, {_ids('source', "'summarize: ' || target_sum", MAX_SOURCE)}, {_ids('target', 'gen_sum', MAX_TARGET)},
encoded AS (
  SELECT article_id, coalesce(s.ids, []) AS source_ids, coalesce(t.ids, []) AS target_ids
  FROM pairs LEFT JOIN source s USING (article_id) LEFT JOIN target t USING (article_id))"""

DECODED = f"""
decoded AS (
  SELECT article_id, coalesce(string_agg(s.token, ' ' ORDER BY s.pos) FILTER (v.id IS NOT NULL), '') AS source_text,
  FROM pairs LEFT JOIN source_words s USING (article_id) LEFT JOIN vocab v USING (token) GROUP BY article_id),
decoded_target AS (
  SELECT article_id, coalesce(string_agg(s.token, ' ' ORDER BY s.pos) FILTER (v.id IS NOT NULL), '') AS target_text,
  FROM pairs LEFT JOIN target_words s USING (article_id) LEFT JOIN vocab v USING (token) GROUP BY article_id)"""

# Decoded texts with one sentence on a line.
DECODED_LINES = f"""
decoded_lines AS (
  SELECT article_id, array_to_string({_sentences(rf"regexp_replace(target_text, '^{SPACE}+|{SPACE}+$', '', 'g')")}, {NL}) AS target_sum,
         array_to_string({_sentences(rf"regexp_replace(source_text, '^{SPACE}+|{SPACE}+$', '', 'g')")}, {NL}) AS gen_sum
  FROM decoded JOIN decoded_target USING (article_id))"""

ENCODED_ROWS = f"""
WITH {PAIRS}, {ENCODED}
SELECT article_id, array_to_string({_padded('source_ids', MAX_SOURCE, PAD)}, ' ') AS input_ids,
       array_to_string({_padded('list_transform(source_ids, lambda x: 1)', MAX_SOURCE, 0)}, ' ') AS attention_mask,
       array_to_string({_padded('target_ids', MAX_TARGET, IGNORED_LABEL)}, ' ') AS labels
FROM encoded"""


# Several references: a gram counts at most as often as in the reference that has most of it.
REFERENCE_LISTS = f"""
lists AS (
  SELECT article_id, gen_sum, [target_sum, gen_sum[:length(gen_sum) // 2] || ' ' || target_sum[length(target_sum) // 2 + 1:],
         gen_sum[:length(gen_sum) // 2] || ' ' || gen_sum[:length(gen_sum) // 2]][:length(target_sum) % 3 + 1] AS refs FROM pairs),
cands AS (SELECT article_id, {_bleu_tokens('gen_sum')} AS cand FROM lists),
each_ref AS (SELECT article_id, r, {_bleu_tokens('one')} AS ref FROM (
  SELECT article_id, unnest(refs) AS one, generate_subscripts(refs, 1) AS r FROM lists)),
lengths AS (
  SELECT article_id, any_value(len(cand)) AS gen_len, arg_min(len(ref), (abs(len(ref) - len(cand)), len(ref))) AS ref_len
  FROM cands JOIN each_ref USING (article_id) GROUP BY article_id)""" + "".join(f"""
, cand{n} AS (
  SELECT article_id, gram, count(*) AS c FROM (SELECT article_id, unnest(list_transform(range(1, len(cand) - {n - 2}),
    lambda i: array_to_string(cand[i:i + {n - 1}], ' '))) AS gram FROM cands) GROUP BY ALL),
ref{n} AS (
  SELECT article_id, gram, max(c) AS c FROM (
    SELECT article_id, r, gram, count(*) AS c FROM (SELECT article_id, r, unnest(list_transform(range(1, len(ref) - {n - 2}),
      lambda i: array_to_string(ref[i:i + {n - 1}], ' '))) AS gram FROM each_ref) GROUP BY ALL) GROUP BY article_id, gram),
sum{n} AS (
  SELECT coalesce((SELECT sum(least(a.c, b.c)) FROM cand{n} a JOIN ref{n} b USING (article_id, gram)), 0)::BIGINT AS match{n},
         coalesce((SELECT sum(c) FROM cand{n}), 0)::BIGINT AS total{n})""" for n in range(1, 5)) + """,
counts AS (
  SELECT coalesce(sum(gen_len), 0)::BIGINT AS gen_len, coalesce(sum(ref_len), 0)::BIGINT AS ref_len,
         any_value(match1) AS match1, any_value(match2) AS match2, any_value(match3) AS match3, any_value(match4) AS match4,
         any_value(total1) AS total1, any_value(total2) AS total2, any_value(total3) AS total3, any_value(total4) AS total4
  FROM lengths, sum1, sum2, sum3, sum4)"""

# The trained sentence splitter, over tokens and the tokens beside them.
IN_SPACE = SPACE[1:-1]
CANDIDATE = r"""[.!?]["'')\]}]*$"""


def _core(token: str) -> str:
    return rf"""regexp_replace(regexp_replace({token}, '^["''(\[{{]+', ''), '["'')\]}}]+$', '')"""


def _word(core: str) -> str:
    word = f"regexp_replace(lower({core}), '[.!?,;:]+$', '')"
    return rf"(CASE WHEN regexp_matches({word}, '^[0-9][0-9.,]*$') THEN '#' WHEN regexp_matches({word}, '[\p{{L}}\p{{N}}]') THEN {word} END)"


def _likelihood(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


SPLITTER = rf"""
token_rows AS (
  SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM (SELECT doc_id, {_pieces('text')} AS toks FROM documents)),
token_cores AS (SELECT doc_id, i, {_core('token')} AS core FROM token_rows),
token_words AS (SELECT doc_id, i, core, {_word('core')} AS word FROM token_cores),
beside AS (
  SELECT word, core, lag(core) OVER one AS before, lag(word) OVER one AS before_word FROM token_words WINDOW one AS (PARTITION BY doc_id ORDER BY i)),
seen AS (
  SELECT word, ends_with(core, '.') AS period, regexp_matches(core, '^\p{{Lu}}') AS capital,
         CASE WHEN before IS NULL THEN '' WHEN regexp_matches(before, '[!?]$') THEN '!' WHEN ends_with(before, '.') THEN coalesce(before_word, '.') END AS after
  FROM beside WHERE word IS NOT NULL),
corpus AS (SELECT count(*) FILTER (period) / count(*) AS rate, count(*) AS n FROM seen),
word_totals AS (
  SELECT word, count(*) FILTER (period) AS n_period, count(*) FILTER (NOT period) AS n_plain, count(*) FILTER (NOT capital) AS n_small,
         count(*) FILTER (capital AND after IS NULL) AS n_inside, length(replace(word, '.', '')) AS letters FROM seen GROUP BY word),
word_ratios AS (
  SELECT *, 2 * ({_likelihood('n_period', '(n_period + n_plain)', '0.99')} - {_likelihood('n_period', '(n_period + n_plain)', 'rate')})
         * exp(-letters) * (length(word) - letters + 1) * pow(letters, -n_plain) AS ratio
  FROM word_totals, corpus),
abbreviations AS (SELECT word FROM word_ratios WHERE n_period > 0 AND ratio >= 0.3 AND word <> '#'),
behind AS (
  SELECT word, capital, after IN (SELECT word FROM abbreviations) OR regexp_matches(after, '^\p{{L}}$') AS doubt, after = '#' AS number
  FROM seen WHERE after <> ''),
behind_totals AS (
  SELECT word, count(*) FILTER (NOT doubt AND NOT number) AS n_first, count(*) FILTER (doubt AND capital) AS n_met FROM behind GROUP BY word),
all_ends AS (SELECT coalesce(sum(n_first), 0) AS n_ends FROM behind_totals),
starts AS (
  SELECT w.*, coalesce(n_first, 0) AS n_first, coalesce(n_met, 0) AS n_met, n_period + n_plain AS total, n_ends, n
  FROM word_ratios w LEFT JOIN behind_totals USING (word), all_ends),
splitter AS (
  SELECT word, n_period, n_plain, ratio, word IN (SELECT word FROM abbreviations) AS abbreviation, n_first, n_met, n_small, n_inside,
         CASE WHEN n_first > 0 AND n_first / n_ends > (total - n_first) / (n - n_ends) THEN 2 * (
           {_likelihood('n_first', 'n_ends', '(n_first / n_ends)')} + {_likelihood('(total - n_first)', '(n - n_ends)', '((total - n_first) / (n - n_ends))')}
           - {_likelihood('n_first', 'n_ends', '(total / n)')} - {_likelihood('(total - n_first)', '(n - n_ends)', '(total / n)')}) ELSE 0 END AS starts
  FROM starts),
splitter_words AS (
  SELECT word, n_period::BIGINT AS n_period, n_plain::BIGINT AS n_plain, round(ratio, 6) + 0.0 AS ratio, abbreviation, n_first::BIGINT AS n_first,
         round(starts, 6) + 0.0 AS starts, n_met::BIGINT AS n_met, (starts >= 30 AND word <> '#') OR (n_small > 0 AND n_inside = 0) AS opens
  FROM splitter)"""

TRAINED_LINES = rf"""
chunk_rows AS (
  SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^{IN_SPACE}]+{SPACE}*') AS c FROM documents)),
chunk_tokens AS (SELECT doc_id, i, chunk, regexp_replace(chunk, '{SPACE}+$', '') AS token FROM chunk_rows),
chunk_cores AS (SELECT *, {_core('token')} AS core FROM chunk_tokens),
chunk_words AS (SELECT *, {_word('core')} AS word FROM chunk_cores),
followed AS (
  SELECT *, lead(core) OVER one AS next_core, lead(word) OVER one AS next_word FROM chunk_words WINDOW one AS (PARTITION BY doc_id ORDER BY i)),
judged AS (
  SELECT doc_id, i, chunk, token, CASE
    WHEN next_core IS NULL OR NOT regexp_matches(token, '{CANDIDATE}') THEN false
    WHEN NOT ends_with(core, '.') OR word IS NULL THEN true
    WHEN word = '#' THEN NOT regexp_matches(next_core, '^\p{{Ll}}')
    ELSE NOT (regexp_matches(word, '^\p{{L}}$') OR word IN (SELECT word FROM splitter_words WHERE abbreviation))
         OR (regexp_matches(next_core, '^\p{{Lu}}') AND next_word IN (SELECT word FROM splitter_words WHERE opens)) IS TRUE END AS ends
  FROM followed),
lines_again AS (SELECT doc_id, string_agg(CASE WHEN ends THEN token || {NL} ELSE chunk END, '' ORDER BY i) AS text FROM judged GROUP BY doc_id),
trained_lines AS (
  SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN regexp_extract(d.text, '^{SPACE}*') || coalesce(l.text, '') END AS text
  FROM documents d LEFT JOIN lines_again l USING (doc_id))"""

ORACLE: dict[str, str] = {
    "split_store": f"""
{ROWS} SELECT * FROM prepared WHERE split IN ('val', 'test') OR {LONG_SUMMARY}""",
    "named_splits": f"""
WITH {PAIRS} SELECT target_sum AS text, gen_sum AS summary, CASE length(target_sum) % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split FROM pairs""",
    "generate_resumed": f"{ROWS}, {LONGEST} SELECT article_id, section_idx, section_id, gen_sum FROM generated",
    "head_samples_descending": f"SELECT doc_id, lang, text FROM documents ORDER BY lang DESC, doc_id LIMIT {HEAD}",
    "ingested_articles": f"""
WITH {ARTICLES},
own AS (SELECT doc_id, count(*) AS n FROM abstract GROUP BY doc_id)
SELECT CASE WHEN lang = 'es' THEN '{{"article_id": "' || doc_id || '", "abstract_text": [' ELSE doc_id::VARCHAR END AS value,
       CASE WHEN lang <> 'es' THEN coalesce(n, 0)::INTEGER END AS n_sentences, lang = 'es' AS broken,
       (SELECT count(*) FROM documents WHERE lang <> 'es') AS n_rows, (SELECT count(*) FROM documents WHERE lang = 'es') AS n_broken
FROM documents LEFT JOIN own USING (doc_id)""",
    "bleu_references": f"WITH {PAIRS}, {REFERENCE_LISTS} SELECT *, round({BLEU}, 6) AS bleu FROM counts",
    "splitter_words": f"WITH {SPLITTER} SELECT * FROM splitter_words",
    "trained_sentence_lines": f"WITH {SPLITTER}, {TRAINED_LINES} SELECT * FROM trained_lines",
    "trained_sentence_lines_joined": f"WITH {SPLITTER}, {TRAINED_LINES} SELECT * FROM trained_lines",
    "best_section": f"""
WITH {ARTICLES}, {_scores()}
SELECT doc_id::VARCHAR AS article_id, m::INTEGER AS sent_idx, a.s AS sentence, sec::INTEGER AS section_idx,
       round(score::DOUBLE, 6) AS score
FROM best JOIN abstract a USING (doc_id, m)""",
    "best_section_dealt": f"""
WITH {ARTICLES}, {_scores()}
SELECT doc_id::VARCHAR AS article_id, m::INTEGER AS sent_idx, a.s AS sentence, sec::INTEGER AS section_idx,
       round(score::DOUBLE, 6) AS score
FROM best JOIN abstract a USING (doc_id, m)""",
    "best_section_unmarked": f"""
WITH {ARTICLES}, {_scores(UNMARKED)}
SELECT doc_id::VARCHAR AS article_id, m::INTEGER AS sent_idx, sec::INTEGER AS section_idx,
       round(score::DOUBLE, 6) AS score
FROM best WHERE score >= 0.5""",
    "sentence_section_scores": f"""
WITH {ARTICLES}, {_scores()}
SELECT doc_id::VARCHAR AS article_id, sec::INTEGER AS section_idx, m::INTEGER AS sent_idx,
       round(score::DOUBLE, 6) AS score FROM scores""",
    "section_types": f"""
WITH {ARTICLES}, {TYPES}
SELECT doc_id::VARCHAR AS article_id, sec::INTEGER AS section_idx, head AS section_head, section_id
FROM section JOIN head_type USING (head)""",
    "section_lengths": f"""
WITH {ARTICLES}
SELECT doc_id::VARCHAR AS article_id, sec::INTEGER AS section_idx, coalesce(n_sentences, 0)::INTEGER AS n_sentences,
       len(string_split(coalesce(document, ''), ' '))::INTEGER AS document_len
FROM section LEFT JOIN section_text USING (doc_id, sec)""",
    "collect_summaries": f"""
WITH {ARTICLES}, {_scores()}
SELECT doc_id::VARCHAR AS article_id, sec::INTEGER AS section_idx, string_agg(a.s, ' ' ORDER BY m) AS section_summary
FROM best JOIN abstract a USING (doc_id, m) GROUP BY doc_id, sec""",
    "regroup_articles": f"""
WITH {ARTICLES},
heads AS (SELECT doc_id, string_agg(head, '|' ORDER BY sec) AS heads FROM section GROUP BY doc_id),
bodies AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i, j) AS body FROM sentences GROUP BY doc_id)
SELECT doc_id::VARCHAR AS article_id, heads, coalesce(body, '') AS body FROM heads LEFT JOIN bodies USING (doc_id)""",
    "prepare_train": f"""
WITH {ARTICLES}, {TYPES}, {_scores()}, {_prepared(LONG_SUMMARY)} SELECT * EXCLUDE (split) FROM prepared""",
    "prepare_stemmed": f"""
WITH {ARTICLES}, {ARTICLE_STEMS}, {TYPES}, {_scores(stemmed='stemmed_')}, {_prepared(LONG_SUMMARY)} SELECT * EXCLUDE (split) FROM prepared""",
    "prepare_eval": f"{ROWS} SELECT * EXCLUDE (split) FROM prepared",
    "prepare_splits": f"""
{ROWS} SELECT * FROM prepared WHERE split IN ('val', 'test') OR {LONG_SUMMARY}""",
    "json_roundtrip": f"""
{ROWS} SELECT * FROM prepared WHERE split IN ('val', 'test') OR {LONG_SUMMARY}""",
    "prepare_pooled": POOLED,
    "rouge1_pairs": f"WITH {PAIRS}, {_token_lists('pairs')}, {_rouge_n(1)} {_score_rows('rouge1')}",
    "rouge2_pairs": f"WITH {PAIRS}, {_token_lists('pairs')}, {_rouge_n(2)} {_score_rows('rouge2')}",
    "rougeL_pairs": f"WITH {PAIRS}, {_token_lists('pairs')}, {ROUGE_L} {_score_rows('rougeL')}",
    "rougeLsum_pairs": f"WITH RECURSIVE {PAIRS}, {_line_lists('pairs', False)}, {ROUGE_LSUM} {_score_rows('rougeLsum')}",
    "score_stemmed": f"""
WITH RECURSIVE {PAIRS}, {_line_lists('pairs', True)}, {_rouge_n(1)}, {_rouge_n(2)}, {ROUGE_L}, {ROUGE_LSUM}, {LINES_PERCENT}
SELECT * FROM percent""",
    "score_pairs": f"WITH {PAIRS}, {FLAT}, {_all_scores('flat')} SELECT * FROM percent",
    "score_standard": f"WITH {PAIRS}, {FLAT}, {_all_scores('flat')} {SUMMARY}",
    "generate_rows": f"{ROWS}, {LONGEST} SELECT article_id, section_idx, section_id, gen_sum FROM generated",
    "assemble_rows": f"{ROWS}, {LONGEST}, {ASSEMBLED} SELECT * FROM assembled",
    "assemble_scores": f"{ROWS}, {LONGEST}, {ASSEMBLED}, {_all_scores('assembled')} {SUMMARY}",
    "bootstrap_ci": f"""
WITH {PAIR_SCORES}, {_draws('pairs')}, {INTERVALS}
SELECT metric, statistic, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi FROM intervals""",
    "ci_report": f"""
WITH {PAIR_SCORES}, {_draws('pairs')}, {INTERVALS},
report_lines AS (
  SELECT replace(replace(metric, 'rouge', ''), 'L', 'l') AS x, list_position(['fmeasure', 'recall', 'precision'], statistic) AS s,
         printf('rouge_%s_%s: %.4f with confidence interval (%.4f, %.4f)', x,
                CASE statistic WHEN 'fmeasure' THEN 'f_score' ELSE statistic END, value, lo, hi) AS line
  FROM intervals)
SELECT string_agg(CASE WHEN s = 1 THEN {NL} || 'ROUGE-' || x || ':' || {NL} ELSE '' END || line, {NL} ORDER BY x, s) AS value
FROM report_lines""",
    "corpus_rouge": f"""
WITH {PAIRS}, {FLAT}, {_token_lists('flat')}, {_rouge_n(1)}, {_rouge_n(2)}, {ROUGE_L}, {_draws('flat')},
cells AS ({CELLS}),
replicate AS (
  SELECT metric, rep, sum(w * x) / sum(w) AS x FROM cells JOIN draws USING (article_id)
  WHERE statistic = 'fmeasure' GROUP BY ALL),
mids AS (SELECT metric, round(round(quantile_cont(x, 0.5) * 100, 4), 4) AS value FROM replicate GROUP BY metric)
SELECT metric, value FROM mids UNION ALL SELECT 'rougeLsum', value FROM mids WHERE metric = 'rougeL'""",
    "corpus_rouge_stemmed": f"""
WITH RECURSIVE {PAIRS}, {_line_lists('pairs', True)}, {_rouge_n(1)}, {_rouge_n(2)}, {ROUGE_L}, {ROUGE_LSUM}, {_draws('pairs')},
cells AS ({FOUR_CELLS}), {MIDS} SELECT * FROM mids""",
    "corpus_bleu": f"WITH {PAIRS}, {_bleu('pairs')} SELECT round({BLEU}, 6) AS bleu FROM counts",
    "bleu_counts": f"WITH {PAIRS}, {_bleu('pairs')} SELECT * FROM counts",
    "encode_rows": ENCODED_ROWS,
    "encode_rows_joined": ENCODED_ROWS,
    "encode_repeated": ENCODED_ROWS,
    "encode_repeated_joined": ENCODED_ROWS,
    "json_pairs": f"""
WITH {PAIRS}
SELECT target_sum AS text, gen_sum AS summary,
       CASE length(target_sum) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM pairs""",
    "read_translation_files": f"WITH {PAIRS} SELECT gen_sum AS text, target_sum AS summary FROM pairs",
    "named_split": f"""
WITH {PAIRS} SELECT target_sum AS text, gen_sum AS summary FROM pairs WHERE length(target_sum) % 2 = 1""",
    "encode_tokenizer": f"""
WITH {PAIRS}, sizes AS (
  SELECT article_id, list_append(list_transform({_pieces('target_sum')}[1:{MAX_SOURCE - 1}], lambda w: len(w)), 0) AS source_ids,
         list_append(list_transform({_pieces('gen_sum')}[1:{MAX_TARGET - 1}], lambda w: len(w)), 0) AS target_ids FROM pairs)
SELECT article_id, array_to_string(source_ids, ' ') AS input_ids,
       array_to_string(list_transform(source_ids, lambda x: 1), ' ') AS attention_mask,
       array_to_string(target_ids, ' ') AS labels FROM sizes""",
    "unmask_decode": f"WITH {PAIRS}, {ENCODED}, {DECODED} SELECT article_id, target_text AS text FROM decoded_target",
    "gen_length": f"WITH {PAIRS}, {ENCODED} SELECT round(avg(len(source_ids)), 4) AS gen_len FROM encoded",
    "compute_metrics": f"""
WITH {PAIRS}, {ENCODED}, {DECODED},
decoded_pairs AS (
  SELECT article_id, target_text AS target_sum, source_text AS gen_sum FROM decoded JOIN decoded_target USING (article_id)),
{_bleu('decoded_pairs')}
SELECT 'bleu' AS metric, round({BLEU}, 4) AS value FROM counts
UNION ALL SELECT 'gen_len', round(avg(len(source_ids)), 4) FROM encoded""",
    "compute_metrics_summarization": f"""
WITH RECURSIVE {PAIRS}, {ENCODED}, {DECODED}, {DECODED_LINES}, {_line_lists('decoded_lines', True)}, {_rouge_n(1)}, {_rouge_n(2)},
{ROUGE_L}, {ROUGE_LSUM}, {_draws('decoded_lines')}, cells AS ({FOUR_CELLS}), {MIDS}
SELECT * FROM mids UNION ALL SELECT 'gen_len', round(avg(len(source_ids)), 4) FROM encoded""",
    "sample_counts": """
SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' ELSE 'test' END AS split, least(count(*), 200) AS samples
FROM documents GROUP BY 1""",
    "translation_pairs": f"WITH {PAIRS} SELECT article_id, gen_sum AS text, target_sum AS summary FROM pairs",
    "head_samples": f"SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT {HEAD}",
    "clean_export": f"WITH {PAIRS}, {FLAT} SELECT * FROM flat",
    "sentence_lines": rf"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'), '([.!?]){SPACE}+', '\1' || {NL}, 'g') AS text
FROM documents""",
    "prediction_lines": rf"""
WITH {PAIRS} SELECT regexp_replace(regexp_replace(gen_sum, '^{SPACE}+|{SPACE}+$', '', 'g'), '\r\n|[\n\r\f\v]', ' ', 'g') AS value
FROM pairs""",
    "csv_roundtrip": f"WITH {PAIRS} SELECT target_sum AS text, gen_sum AS summary FROM pairs",
}
