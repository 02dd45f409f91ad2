"""Kinloom: pedigree, genotype and interval analytics as PySpark DataFrame operations."""
