"""Market time-series on Spark: bar quality, gaps, indicators, fills, equity, tearsheets."""
