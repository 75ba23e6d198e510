"""Peptide fragmentation analytics as lazy Spark DataFrame plans."""
