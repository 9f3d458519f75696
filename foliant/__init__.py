"""Document analytics on Spark: DataFrame-in, DataFrame-out operators over books, chapters and blocks."""
