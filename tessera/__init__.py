"""Tessera: corpus navigation, ranking and evaluation expressed as Spark DataFrame plans."""
