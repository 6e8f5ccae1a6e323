"""K1: a caller's extractor over batches of episodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronoweave.operators.extraction import validate_entities


def with_extractor(
    episodes: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    registry: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Entities found by `fn` (batch of episodes in, entity rows out), validated.

    The rows need (label, attributes); returns the valid and the rejected ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return validate_entities(episodes.mapInPandas(run, schema), registry)
