"""Spark jobs for the tables of unstructured-grid estuary and coastal models."""
