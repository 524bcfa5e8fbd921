"""Pattern-balanced time-series corpora and training data on Spark."""
