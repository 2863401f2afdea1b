"""A stream of targets interlinked with a static source: an extension of the batch join, tile by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.envelope import Theta
from ..operators import interlink


def link_stream(source: DataFrame, targets: DataFrame, relation: str, t: Theta | interlink.Grid, **options) -> DataFrame:
    """Pairs (source_id, target_id) of a streaming `targets`; stateless, so no watermark is needed.

    The grid's levels are those of the source: a larger target lies on its highest level, on more tiles.
    """
    if relation == "disjoint":
        raise ValueError("disjoint pairs of a stream are all others: take them from the batch")
    return interlink.relate(source, targets, relation, t, **options)
