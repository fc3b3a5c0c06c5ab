"""Weighted text corpora and survey-style records as Spark DataFrame operators."""
