"""Variant annotation and corpus preparation, expressed as Spark DataFrames."""
