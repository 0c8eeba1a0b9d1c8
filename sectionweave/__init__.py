"""Section-wise preparation, generation and scoring of long-document summaries on Spark."""
