"""Tessera: hybrid retrieval and corpus processing as Spark DataFrame plans."""
