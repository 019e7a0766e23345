"""Explanations of entity-resolution decisions as Spark DataFrame plans."""
