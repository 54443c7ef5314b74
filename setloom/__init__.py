"""Set overlap between samples of words, on Spark."""
