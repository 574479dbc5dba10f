"""Analytics over sparse, symmetric, binned pairwise-contact matrices as Spark DataFrames."""

from .schema import ContactMap

__all__ = ["ContactMap"]
