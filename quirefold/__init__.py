"""Spark-first refinement, alignment and curation of text recognised from scanned pages."""
