"""Analyst-report analytics on Spark: metadata, cleaning, price as-of labelling, training sets and text scoring."""
