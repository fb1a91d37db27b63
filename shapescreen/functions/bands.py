"""Order-preserving bands of a score, with borders taken from the data.

A window over all rows of one group runs in one task, and one group may hold a
third of all rows.  Ranks and running sums are therefore computed in two steps:
inside a band of neighbouring scores, and over the bands of a group.  A band is
a monotone function of the score, so the result is exact for any borders; the
borders are quantiles of all scores, so no band has many rows, whatever the
scores' range and however they are spread.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows a band holds, about, and the most bands.
BAND_ROWS = 500_000
MOST_BANDS = 1 << 14
# Even parts of a band.
FINE = 1024

MAX_DOUBLE = 1.7976931348623157e308


def clean_score(score: Column) -> Column:
    """NaN and NULL become 0, infinities the largest finite double of their sign."""
    score = score.cast("double")
    return (
        F.when(score.isNull() | F.isnan(score), F.lit(0.0))
        .when(score == float("inf"), F.lit(MAX_DOUBLE))
        .when(score == float("-inf"), F.lit(-MAX_DOUBLE))
        # -0.0 and 0.0 are one score
        .otherwise(score + F.lit(0.0))
    )


def quantile_borders(scores: DataFrame, rows: int) -> list[float]:
    """The least score, borders between bands of about BAND_ROWS rows, the greatest score.

    One mergeable sketch per task; the driver gets the borders only.
    """
    bands = min(MOST_BANDS, -(-rows // BAND_ROWS))
    shares = [i / bands for i in range(bands + 1)]
    found = scores.agg(F.percentile_approx("score", shares, 4 * max(bands, 2500))).first()[0]
    return sorted({float(v) for v in found or ()})


def with_bands(scores: DataFrame, rows: int) -> DataFrame:
    """Add ``band``, and ``fine``, the part of the band, for finite ``score``; both never decrease as the
    score grows within what they belong to.  ``scores`` is read twice if it has over BAND_ROWS rows."""
    edges = quantile_borders(scores, rows) if rows > BAND_ROWS else []
    if len(edges) < 3:
        return scores.withColumns({"band": F.lit(0).cast("bigint"), "fine": F.lit(0).cast("bigint")})
    splits = [float("-inf"), *edges[1:-1], float("inf")]
    placed = Bucketizer(splits=splits, inputCol="score", outputCol="band").transform(scores)
    band = F.col("band").cast("int")
    # One folded literal, however many edges.
    listed = F.split(F.lit(",".join(map(repr, edges))), ",").cast("array<double>")
    edge = lambda i: F.element_at(listed, i) / 2
    # Halves, as the range of the scores may exceed the greatest double.
    share = (F.col("score") / 2 - edge(band + 1)) / F.nullif(edge(band + 2) - edge(band + 1), F.lit(0.0))
    fine = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * FINE), F.lit(0)), F.lit(FINE - 1))
    # Never NULL: otherwise a join adds a null filter to one side only and the
    # shuffle of the histogram is not shared between its two readers.
    return placed.withColumns({"band": F.coalesce(band.cast("bigint"), F.lit(0)), "fine": fine.cast("bigint")})


def shuffle_key(identifier: Column, seed: int) -> Column:
    """Seeded random order of rows: 32 hex digits, uniform whatever the identifiers look like."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))
