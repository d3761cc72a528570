"""Spark-native evidence analytics: facts, passages, judgements, verdicts and the stores around them."""
