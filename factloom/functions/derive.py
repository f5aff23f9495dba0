"""Facts derived from others: classes of size, duration and shape, and the best date there is."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CERTAIN, STRONG, LIKELY, WEAK = 1.0, 0.85, 0.70, 0.45
# Upper bounds, exclusive, of the classes.
SIZE_BANDS = ((1024, "tiny"), (1 << 20, "small"), (50 << 20, "medium"), (1 << 30, "large"))
DURATION_BANDS = ((5, "instant"), (60, "short"), (600, "medium"), (1800, "long"), (4800, "feature"))


def banded(value: Column, bands: Sequence[tuple[float, str]], beyond: str) -> Column:
    first, *rest = bands
    chain = reduce(lambda c, b: c.when(value < b[0], b[1]), rest, F.when(value < first[0], first[1]))
    return F.when(value.isNotNull(), chain.otherwise(beyond))


def size_class(size: Column) -> Column:
    return banded(size, SIZE_BANDS, "huge")


def duration_class(seconds: Column) -> Column:
    return F.when(seconds != 0, banded(seconds, DURATION_BANDS, "epic"))


def aspect(width: Column, height: Column) -> Column:
    return F.when((width != 0) & (height != 0), F.round(width / height.cast("double"), 4))


def orientation_class(ratio: Column) -> Column:
    return F.when(ratio.isNotNull() & (ratio != 0), F.when(ratio.between(0.95, 1.05), "square").when(ratio < 1, "portrait").otherwise("landscape"))


def happened(sources: Sequence[tuple[str, Column, Column | float]]) -> Column:
    """struct(value, source, confidence) of the first date there is, cut to seconds."""
    made = [
        F.when(
            F.nullif(c.cast("string"), F.lit("")).isNotNull(),
            F.struct(F.left(c.cast("string"), F.lit(19)).alias("value"), F.lit(name).alias("source"), (level if isinstance(level, Column) else F.lit(level)).alias("confidence")),
        )
        for name, c, level in sources
    ]
    return F.coalesce(*made)


def confidence_name(c: Column) -> Column:
    return F.when(c >= CERTAIN, "certain").when(c >= STRONG, "strong").when(c >= LIKELY, "likely").otherwise("weak")
