"""Training-data operations on whole corpora: dedup, scoring, filtering, mixing, encoding."""
