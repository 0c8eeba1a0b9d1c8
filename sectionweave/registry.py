"""The queries of the driver contract, over whole tables and whole texts."""

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import join_sentences, piece_count, postprocess_text
from .operators import aggregate, align, assemble, bleu, columns, encode, generate, rouge, sentence_split
from .plans import evaluate, prepare
from .schemas import SCORING_TYPES
from .session import attach, scratch_path, spread, stored
from .sources import readers, store, writers
from .sources.documents import articles_from_documents, pairs_from_conversations, vocabulary

PAD, UNK = 0, 1
MAX_SOURCE, MAX_TARGET = 512, 128
REPS = 1000
HEAD = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(attach(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(table(spark, sf_dir, "documents"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_conversations(table(spark, sf_dir, "conversations"))


def flat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as they are exported: no line breaks."""
    return writers.export_pairs(pairs(spark, sf_dir))


def long_sentence_summarizer() -> Callable[[list[str]], list[str]]:
    """Stands in for a model: the first of the longest sentences of the whole text."""
    def summarize(texts: list[str]) -> list[str]:
        return [max(re.sub(r"([.!?])[ \t\n\f\r]+", "\\1\n", t).split("\n"), key=lambda s: len(s.split(" "))) for t in texts]
    return summarize


def word_length_tokenizer() -> Callable[[list[str]], list[list[int]]]:
    """Stands in for a subword tokenizer: each word's length, then the end id 0, which cut texts have as well."""
    return lambda texts, longest: [[*[len(w) for w in re.split(r"[ \t\n\f\r]+", t) if w][:longest - 1], 0] for t in texts]


def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.prepare_section_rows(articles(spark, sf_dir), train=False, use_stemmer=False)
    return generate.generate(rows, long_sentence_summarizer, "document", batch_size=6)


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def _score(df: DataFrame) -> DataFrame:
    return _rounded(df, "precision", "recall", "fmeasure")


def best_section(spark, sf_dir):
    aligned = align.best_section(articles(spark, sf_dir), use_stemmer=False)
    return _rounded(aligned.drop(align.ABSTRACT_KEY), "score")


def best_section_dealt(spark, sf_dir):
    """The same sections, articles above 2,000 bytes of section text being compared in parts."""
    aligned = align.best_section(articles(spark, sf_dir), use_stemmer=False, large_bytes=2000)
    return _rounded(aligned.drop(align.ABSTRACT_KEY), "score")


def alignment_work(spark, sf_dir):
    """Pairs of sentences of each article, and how many of them had to be compared."""
    return align.alignment_work(articles(spark, sf_dir), use_stemmer=False)


def best_section_unmarked(spark, sf_dir):
    aligned = align.best_section(articles(spark, sf_dir), min_score=0.5, use_stemmer=False, strip_markers_first=True)
    return _rounded(aligned.drop("sentence", align.ABSTRACT_KEY), "score")


def sentence_section_scores(spark, sf_dir):
    scores = align.sentence_section_scores(articles(spark, sf_dir), use_stemmer=False)
    return _rounded(scores.select("article_id", "section_idx", F.posexplode("summary_scores").alias("sent_idx", "score")),
                    "score")


def section_types(spark, sf_dir):
    return align.section_types(articles(spark, sf_dir)).select("article_id", "section_idx", "section_head", "section_id")


def section_lengths(spark, sf_dir):
    document = join_sentences(F.col("section_text"))
    return align.explode_sections(articles(spark, sf_dir)).select(
        "article_id", "section_idx", F.size("section_text").alias("n_sentences"),
        piece_count(document).alias("document_len"))


def collect_summaries(spark, sf_dir):
    aligned = align.best_section(articles(spark, sf_dir), use_stemmer=False)
    return align.collect_section_summary(aligned).select(
        "article_id", "section_idx", join_sentences(F.col("section_summary")).alias("section_summary"))


def regroup_articles(spark, sf_dir):
    sections = F.col("full_text_sections")
    return align.regroup_articles(align.explode_sections(articles(spark, sf_dir))).select(
        "article_id", F.array_join(sections["section_head"], "|").alias("heads"),
        join_sentences(F.flatten(sections["section_text"])).alias("body"))


def prepare_train(spark, sf_dir):
    return prepare.prepare_section_rows(articles(spark, sf_dir), train=True, use_stemmer=False)


def prepare_eval(spark, sf_dir):
    return prepare.prepare_section_rows(articles(spark, sf_dir), train=False, use_stemmer=False)


def prepare_stemmed(spark, sf_dir):
    return prepare.prepare_section_rows(articles(spark, sf_dir), train=True)


def with_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "val").otherwise("test"))


def prepare_splits(spark, sf_dir):
    return prepare.prepare_section_rows(with_split(articles(spark, sf_dir)), use_stemmer=False)


def prepare_pooled(spark, sf_dir):
    """Language as article_id: one id holds most rows, and copies of an abstract pool their sections."""
    shared = articles_from_documents(table(spark, sf_dir, "documents"), F.col("lang"))
    return prepare.prepare_section_rows(shared, train=False, use_stemmer=False)


def rouge1_pairs(spark, sf_dir):
    return _score(rouge.rouge_n(pairs(spark, sf_dir), 1))


def rouge2_pairs(spark, sf_dir):
    return _score(rouge.rouge_n(pairs(spark, sf_dir), 2))


def rougeL_pairs(spark, sf_dir):
    return _score(rouge.rouge_l(pairs(spark, sf_dir)))


def rougeLsum_pairs(spark, sf_dir):
    return _score(rouge.rouge_lsum(pairs(spark, sf_dir)))


def score_pairs(spark, sf_dir):
    return rouge.score_pairs(flat_pairs(spark, sf_dir)).drop("target_sum", "gen_sum")


def score_standard(spark, sf_dir):
    return _rounded(evaluate.score_standard(flat_pairs(spark, sf_dir)), "rouge1", "rouge2", "rougeLsum")


def score_stemmed(spark, sf_dir):
    return rouge.score_pairs(pairs(spark, sf_dir), use_stemmer=True).drop("target_sum", "gen_sum")


def generate_rows(spark, sf_dir):
    return generated_rows(spark, sf_dir).select("article_id", "section_idx", "section_id", "gen_sum")


def assembled(spark, sf_dir):
    rows = generated_rows(spark, sf_dir).withColumnRenamed("abstract", "target_sum")
    return assemble.assemble(rows, SCORING_TYPES)


def assemble_rows(spark, sf_dir):
    return assembled(spark, sf_dir)


def assemble_scores(spark, sf_dir):
    rows = generated_rows(spark, sf_dir).withColumnRenamed("abstract", "target_sum")
    return _rounded(evaluate.assemble_and_score(rows, SCORING_TYPES), "rouge1", "rouge2", "rougeLsum")


def bootstrap_ci(spark, sf_dir):
    return _rounded(aggregate.bootstrap_ci(pairs(spark, sf_dir), REPS), "value", "lo", "hi")


def ci_report(spark, sf_dir):
    return writers.report_text(aggregate.bootstrap_ci(pairs(spark, sf_dir), REPS))


def corpus_rouge(spark, sf_dir):
    return _rounded(aggregate.corpus_rouge(flat_pairs(spark, sf_dir), REPS, use_stemmer=False), "value", digits=4)


def corpus_rouge_stemmed(spark, sf_dir):
    """The default of the metric: stemmed, over lines."""
    return _rounded(aggregate.corpus_rouge(pairs(spark, sf_dir), REPS), "value", digits=4)


def corpus_bleu(spark, sf_dir):
    return _rounded(bleu.corpus_bleu(pairs(spark, sf_dir)), "bleu")


def bleu_counts(spark, sf_dir):
    return bleu.bleu_counts(pairs(spark, sf_dir))


def reference_lists(spark, sf_dir):
    """Pairs with one to three references: the answer, the question's first half before the answer's second, and that half twice."""
    def half(c: str) -> Column:
        return F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))

    rest = F.substring("target_sum", F.floor(F.length("target_sum") / 2).cast("int") + 1, F.length("target_sum"))
    mixed, twice = F.concat_ws(" ", half("gen_sum"), rest), F.concat_ws(" ", half("gen_sum"), half("gen_sum"))
    refs = F.slice(F.array("target_sum", mixed, twice), 1, F.length("target_sum") % 3 + 1)
    return pairs(spark, sf_dir).select("article_id", refs.alias("target_sum"), "gen_sum")


def bleu_references(spark, sf_dir):
    counts = bleu.bleu_counts(reference_lists(spark, sf_dir))
    return _rounded(counts.withColumn("bleu", bleu.bleu_of_counts()), "bleu")


def _text_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("article_id", F.col("target_sum").alias("text"), F.col("gen_sum").alias("summary"))


def _vocab(spark, sf_dir):
    """Words of all turns."""
    return vocabulary(table(spark, sf_dir, "conversations"), "text")


def _encoded(spark, sf_dir, vocab=None, **options):
    return encode.encode_pairs(_text_pairs(spark, sf_dir), vocab or _vocab(spark, sf_dir), MAX_SOURCE, MAX_TARGET, PAD, unk=UNK,
                               prefix="summarize: ", keys=("article_id",), **options)


def _id_text(df):
    return df.withColumns({c: _joined(F.col(c)) for c in ("input_ids", "attention_mask", "labels")})


def encode_rows(spark, sf_dir):
    return _id_text(_encoded(spark, sf_dir))


def encode_rows_joined(spark, sf_dir):
    """The same rows the way a vocabulary too large to broadcast is looked up."""
    return _id_text(_encoded(spark, sf_dir, max_entries=0))


def encode_tokenizer(spark, sf_dir):
    return _id_text(encode.encode_with(_text_pairs(spark, sf_dir), word_length_tokenizer, MAX_SOURCE, MAX_TARGET,
                                       keys=("article_id",)))


def unmask_decode(spark, sf_dir):
    vocab = stored(_vocab(spark, sf_dir), "vocab")
    return encode.decode(_encoded(spark, sf_dir, vocab), vocab, PAD, special=(UNK,)).select("article_id", "text")


def gen_length(spark, sf_dir):
    return encode.generated_length(_encoded(spark, sf_dir), PAD)


def sample_counts(spark, sf_dir):
    return columns.sample_counts(with_split(articles(spark, sf_dir)), 200, by=("split",))


def compute_metrics(spark, sf_dir):
    vocab = stored(_vocab(spark, sf_dir), "vocab")
    encoded = _encoded(spark, sf_dir, vocab).withColumnRenamed("input_ids", "pred_ids")
    return evaluate.compute_metrics(encoded, vocab, PAD, "translation_en_to_fr", special=(UNK,))


def compute_metrics_summarization(spark, sf_dir):
    vocab = stored(_vocab(spark, sf_dir), "vocab")
    encoded = _encoded(spark, sf_dir, vocab).withColumnRenamed("input_ids", "pred_ids")
    return evaluate.compute_metrics(encoded, vocab, PAD, special=(UNK,))


def translation_pairs(spark, sf_dir):
    record = F.struct(F.col("target_sum").alias("en"), F.col("gen_sum").alias("fr"))
    return columns.translation_pairs(pairs(spark, sf_dir).withColumn("translation", record),
                                     "translation_fr_to_en", keys=("article_id",))


def head_samples(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return columns.head(documents, HEAD, "doc_id")


def head_samples_descending(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return columns.head(documents, HEAD, [F.col("lang").desc(), "doc_id"])


def clean_export(spark, sf_dir):
    return writers.export_pairs(pairs(spark, sf_dir))


def sentence_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", postprocess_text(F.col("text")).alias("text"))


def splitter_words(spark, sf_dir):
    """What the trained splitter learns from all documents."""
    words = _rounded(sentence_split.learn(table(spark, sf_dir, "documents")), "ratio", "starts")
    return words.withColumns({c: F.col(c) + 0.0 for c in ("ratio", "starts")})  # no negative zeros


def trained_sentence_lines(spark, sf_dir, **options):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_split.split_lines(documents, sentence_split.learn(documents), own=True, **options)


def trained_sentence_lines_joined(spark, sf_dir):
    """The same lines the way word lists too long for an expression are looked up."""
    return trained_sentence_lines(spark, sf_dir, max_words=0)


def prediction_lines(spark, sf_dir):
    return writers.prediction_lines(pairs(spark, sf_dir))


def json_roundtrip(spark, sf_dir):
    """Split files written, read with the declared schema, prepared, written and read again."""
    root = scratch_path(spark, "splits")
    whole = with_split(articles(spark, sf_dir)).drop("lang")
    for split in ("train", "val", "test"):
        whole.where(F.col("split") == split).drop("split").write.mode("overwrite").json(f"{root}/{split}.txt")
    rows = prepare.prepare_section_rows(readers.read_splits(spark, root), use_stemmer=False)
    writers.write_splits(rows, root, "task")
    back = [readers.read_rows(spark, f"{writers.task_path(root, 'task')}/{s}").withColumn("split", F.lit(s))
            for s in ("train", "val", "test")]
    return back[0].unionByName(back[1]).unionByName(back[2])


def encode_repeated(spark, sf_dir, **options):
    """A vocabulary that gives words several ids: the smallest counts."""
    vocab = _vocab(spark, sf_dir)
    several = vocab.unionAll(vocab.withColumn("id", F.col("id") + 1_000_000)).unionAll(vocab.select(F.lit(None).cast("string").alias("token"), "id"))
    return _id_text(encode.encode_pairs(_text_pairs(spark, sf_dir), several, MAX_SOURCE, MAX_TARGET, PAD, unk=UNK,
                                        prefix="summarize: ", keys=("article_id",), **options))


def encode_repeated_joined(spark, sf_dir):
    return encode_repeated(spark, sf_dir, max_entries=0)


def json_pairs(spark, sf_dir):
    """Pair files by split, with a field that only some records have, by column names and by position."""
    root = scratch_path(spark, "pair_files")
    whole = _text_pairs(spark, sf_dir).withColumn("note", F.when(F.col("article_id").endswith("1"), "odd"))
    whole = whole.select("text", "summary", "note", (F.length("text") % 3).alias("part"))
    for part in range(3):
        whole.where(F.col("part") == part).drop("part").write.json(f"{root}/{part}.json")
    paths = {name: f"{root}/{part}.json" for part, name in enumerate(("train", "validation"))}
    named = readers.read_pair_splits(spark, {"test": f"{root}/2.json"}, text_col="text", summary_col="summary")
    return readers.read_pair_splits(spark, paths).unionByName(named)


def read_translation_files(spark, sf_dir):
    path = f"{scratch_path(spark, 'translations')}.json"
    record = F.struct(F.col("target_sum").alias("en"), F.col("gen_sum").alias("fr"))
    pairs(spark, sf_dir).select(record.alias("translation")).write.json(path)
    return columns.translation_pairs(readers.read_translations(spark, path), "translation", "fr_XX", "en_XX")


def named_split(spark, sf_dir):
    """One split of a dataset known by name, its columns found by the name as well."""
    path = scratch_path(spark, "named")
    known = _text_pairs(spark, sf_dir).select(F.col("summary").alias("summary"), F.col("text").alias("document"),
                                              F.when(F.length("text") % 2 == 0, "train").otherwise("test").alias("split"))
    known.write.parquet(path)
    return columns.select_pair(readers.load_split(spark, "xsum", "test", {"xsum": path}), dataset="xsum")


def _named_store(spark: SparkSession, rows: DataFrame) -> str:
    path = scratch_path(spark, "store")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    store.write_split_store(rows, path, name)
    return name


def split_store(spark, sf_dir):
    """Prepared rows, written as a table laid out by split in one scan; every split is read back by its name."""
    name = _named_store(spark, prepare.prepare_section_rows(with_split(articles(spark, sf_dir)), use_stemmer=False))
    return reduce(DataFrame.unionByName, (store.read_split(spark, name, s) for s in store.split_names(spark, name)))


def named_splits(spark, sf_dir):
    """Both splits of a dataset known by name."""
    known = _text_pairs(spark, sf_dir).select("summary", F.col("text").alias("document"),
                                              F.when(F.length("text") % 2 == 0, "train").otherwise("test").alias("split"))
    name = _named_store(spark, known)
    parts = [columns.select_pair(store.read_split(spark, name, s), dataset="xsum").withColumn("split", F.lit(s)) for s in store.split_names(spark, name)]
    return reduce(DataFrame.unionByName, parts)


def ingested_articles(spark, sf_dir):
    """Articles as JSON lines, those in Spanish broken off: what is read, what is in quarantine, and the counts of both."""
    root = scratch_path(spark, "lines")
    whole = F.to_json(F.struct("article_id", "abstract_text", "section_names", "sections"))
    torn = F.concat(F.lit('{"article_id": "'), "article_id", F.lit('", "abstract_text": ['))
    articles(spark, sf_dir).select(F.when(F.col("lang") == "es", torn).otherwise(whole).alias("value")).write.text(root)
    found = store.ingest_articles(spark, root, scratch_path(spark, "ingested"))
    rows = found.rows.select(F.col("article_id").alias("value"), F.size("abstract_text").alias("n_sentences"), F.lit(False).alias("broken"))
    torn_rows = found.broken.select(F.col("line").alias("value"), F.lit(None).cast("int").alias("n_sentences"), F.lit(True).alias("broken"))
    return rows.unionByName(torn_rows).withColumns({"n_rows": F.lit(found.n_rows).cast("long"), "n_broken": F.lit(found.n_broken).cast("long")})


def generate_resumed(spark, sf_dir):
    """The generated rows of a run that had got as far as the introductions, and is taken up again."""
    rows = prepare.prepare_section_rows(articles(spark, sf_dir), train=False, use_stemmer=False)
    kept = scratch_path(spark, "generated")
    generate.generate_missing(rows.where("section_id = 'i'"), long_sentence_summarizer, kept, batch_size=6, n_batches=4)
    made = generate.generate_resumable(rows, long_sentence_summarizer, kept, batch_size=6, n_batches=4)
    return made.select("article_id", "section_idx", "section_id", "gen_sum")


def csv_roundtrip(spark, sf_dir):
    path = f"{scratch_path(spark, 'pairs')}.csv"
    _text_pairs(spark, sf_dir).drop("article_id").write.mode("overwrite").csv(
        path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_pairs(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        best_section, best_section_dealt, alignment_work, best_section_unmarked, sentence_section_scores, section_types, section_lengths,
        collect_summaries, regroup_articles, prepare_train, prepare_eval, prepare_splits, prepare_pooled,
        prepare_stemmed, rouge1_pairs, rouge2_pairs, rougeL_pairs, rougeLsum_pairs, score_pairs, score_standard,
        score_stemmed, generate_rows, assemble_rows, assemble_scores, bootstrap_ci, ci_report, corpus_rouge, corpus_rouge_stemmed,
        corpus_bleu, bleu_counts, bleu_references, encode_rows, encode_rows_joined, encode_tokenizer, unmask_decode, gen_length,
        sample_counts, compute_metrics, compute_metrics_summarization, translation_pairs, head_samples, clean_export, sentence_lines,
        splitter_words, trained_sentence_lines, trained_sentence_lines_joined,
        prediction_lines, json_roundtrip, csv_roundtrip, encode_repeated, encode_repeated_joined, json_pairs,
        read_translation_files, named_split, named_splits, split_store, ingested_articles, generate_resumed,
        head_samples_descending,
    )
}
