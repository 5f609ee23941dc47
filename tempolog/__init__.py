"""Temporal-policy analytics on Spark: policies in metric first-order temporal logic compiled to DataFrame plans."""
