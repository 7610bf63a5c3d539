"""Catalogue similarity and analytics on PySpark."""
