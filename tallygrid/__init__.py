"""tallygrid: sparse observation x feature analytics expressed as Spark DataFrames."""

from tallygrid.operators.matrix import Matrix

__all__ = ["Matrix"]
