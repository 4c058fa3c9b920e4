"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator lives in
its own module; ``catalog`` registers one query per operator."""
