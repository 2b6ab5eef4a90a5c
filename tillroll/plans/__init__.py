"""Compositions of operators: the rebuild pipeline, the processed warehouse and
the registered checks used by ``__spark_entry__``."""
