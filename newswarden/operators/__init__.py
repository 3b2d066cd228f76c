"""Operators: DataFrames in, DataFrames out; time, thresholds and lexicon come in a Context."""
