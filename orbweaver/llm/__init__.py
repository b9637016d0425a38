"""Operators for training-data pipelines. Nothing else in orbweaver imports this subpackage."""
