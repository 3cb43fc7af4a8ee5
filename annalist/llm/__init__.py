"""Operators of large-scale training-data pipelines. Nothing else in annalist imports this subpackage."""
