"""lexspark: text, lexicon and retrieval operators expressed as Spark DataFrames."""
