"""Operators of a training-data pipeline. Nothing else in docjobs imports this subpackage."""
