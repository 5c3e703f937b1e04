"""Operators for large training-data pipelines. Nothing else in ctxspark imports this subpackage."""
