"""normlens — label-evaluation analytics on Spark DataFrames.

Prepare labelled comments, batch and score them, recover predictions
from free-text replies, and compute run metrics and cross-community
statistics.  Every public operator is ``DataFrame -> DataFrame`` and lazy.
"""

__all__ = ["constants", "session"]
