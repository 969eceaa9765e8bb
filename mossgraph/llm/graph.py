"""Connected components, with the folder of the result named as this subpackage does, so that it can be discarded."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import components


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(id, component)``: for each id on an edge the smallest id that it reaches."""
    found = components(edges)
    found.scratch_path = found.saved_path
    return found
