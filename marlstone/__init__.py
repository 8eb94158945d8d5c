"""A PySpark library for text corpora and event timelines."""
