"""Operations of a training-data pipeline, each a function from DataFrames to a DataFrame.

Nothing outside this package, its tests and ``corpus_pipeline.py`` imports it.
"""
