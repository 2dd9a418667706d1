"""Tabular data quality on Spark: profile, validate, mine rules, repair, audit and score."""
