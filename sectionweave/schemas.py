"""Table layouts and the fixed values of the data model."""

from pyspark.sql import types as T

ARTICLE = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("abstract_text", T.ArrayType(T.StringType())),
    T.StructField("section_names", T.ArrayType(T.StringType())),
    T.StructField("sections", T.ArrayType(T.ArrayType(T.StringType()))),
])

ROW = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("section_idx", T.IntegerType()),
    T.StructField("section_id", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("abstract", T.StringType()),
])

# Header word -> section type code.
KEYWORDS = {
    "introduction": "i",
    "case": "i",
    "purpose": "i",
    "objective": "i",
    "objectives": "i",
    "aim": "i",
    "summary": "i",
    "findings": "l",
    "background": "i",
    "background/aims": "i",
    "literature": "l",
    "studies": "l",
    "related": "l",
    "methods": "m",
    "method": "m",
    "techniques": "m",
    "methodology": "m",
    "results": "r",
    "result": "r",
    "experiment": "r",
    "experiments": "r",
    "experimental": "r",
    "discussion": "c",
    "limitations": "d",
    "conclusion": "c",
    "conclusions": "c",
    "concluding": "c",
}

# Code of an unrecognised header, types kept for training rows,
# types kept when section outputs are put together again, split names.
OTHER_SECTION = "o"
TRAINING_TYPES = ("i", "m", "r", "l", "c")
SCORING_TYPES = ("i", "m", "r", "c")
SPLITS = ("train", "val", "test")

# Dataset name -> (text column, summary column).
DATASET_COLUMNS = {
    "amazon_reviews_multi": ("review_body", "review_title"),
    "big_patent": ("description", "abstract"),
    "cnn_dailymail": ("article", "highlights"),
    "orange_sum": ("text", "summary"),
    "pn_summary": ("article", "summary"),
    "psc": ("extract_text", "summary_text"),
    "samsum": ("dialogue", "summary"),
    "thaisum": ("body", "summary"),
    "xglue": ("news_body", "news_title"),
    "xsum": ("document", "summary"),
    "wiki_summary": ("article", "highlights"),
}

# Fixed value: marks label positions that a loss must skip.
IGNORED_LABEL = -100
