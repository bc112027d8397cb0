"""Property-listing analytics on Spark: clean, dedupe, merge, profile, featurise, model, score."""
