"""Schemas compiled to Spark types, and the catalogue of named queries with their SQL."""
