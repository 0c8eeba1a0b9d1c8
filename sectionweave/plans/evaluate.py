"""Generated texts to metrics."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import postprocess_text, strip
from ..operators.aggregate import corpus_rouge, score_summary
from ..operators.assemble import assemble
from ..operators.bleu import corpus_bleu
from ..operators.encode import decode_columns, generated_length
from ..operators.rouge import score_pairs
from ..operators.sentence_split import split_lines
from ..session import stored


def assemble_and_score(rows: DataFrame, select_sections: Sequence[str] | None = None) -> DataFrame:
    """Section outputs joined per article, scored, and summarised as mean and deviation."""
    return score_summary(score_pairs(assemble(rows, select_sections)))


def score_standard(pairs: DataFrame) -> DataFrame:
    """The same for texts generated from whole documents."""
    return score_summary(score_pairs(pairs))


def compute_metrics(predictions: DataFrame, vocab: DataFrame, pad: int, task: str = "summarization",
                    special: tuple[int, ...] = (), key: str = "article_id", splitter: DataFrame | None = None) -> DataFrame:
    """Metric rows of predicted and label ids (``pred_ids``, ``labels``).

    Summarization is scored by stemmed ROUGE over sentence lines, translation by
    BLEU; both add the mean generated length. ``splitter``, what the trained sentence
    splitter has learnt, takes the place of breaks after every closing mark.
    """
    if not task.startswith(("summarization", "translation")):
        raise ValueError(f"task {task!r} is neither summarization nor translation")
    texts = decode_columns(predictions, vocab, pad, {"gen_sum": "pred_ids", "target_sum": "labels"}, special)
    clean = postprocess_text if task.startswith("summarization") and splitter is None else strip
    pairs = texts.select(key, clean(F.col("target_sum")).alias("target_sum"), clean(F.col("gen_sum")).alias("gen_sum"))
    if task.startswith("summarization") and splitter is not None:
        pairs = stored(split_lines(split_lines(pairs, splitter, "target_sum"), splitter, "gen_sum"), "split_pairs")
    if task.startswith("summarization"):
        scores = corpus_rouge(pairs, key=key)
    else:
        scores = corpus_bleu(pairs).select(F.lit("bleu").alias("metric"), F.round("bleu", 4).alias("value"))
    length = generated_length(predictions, pad, "pred_ids")
    return scores.unionByName(length.select(F.lit("gen_len").alias("metric"), F.col("gen_len").alias("value")))
