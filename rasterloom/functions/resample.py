"""Chroma upsampling with triangle weights, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, shr


def _half(i: Column) -> Column:
    return F.call_function("div", i, F.lit(2)).cast("int")


def upsample_h2v1(row: Column, width: Column) -> Column:
    """A row at twice its width, cut to ``width``: weights 3 to 1 with biases 1 and 2; the ends are copied."""
    n = F.size(row)

    def at(i: Column) -> Column:
        own = F.get(row, _half(i))
        back, ahead = F.get(row, _half(i) - 1), F.get(row, _half(i) + 1)
        return F.when((i == 0) | (i == 2 * n - 1) | (n == 1), own).when(i % 2 == 1, shr(3 * own + ahead + 2, 2)).otherwise(shr(3 * own + back + 1, 2))

    return F.transform(F.sequence(F.lit(0), width - 1), at)


def upsample_h2v2(near: Column, own: Column, width: Column) -> Column:
    """A row between two rows: sums 3 own + near down the columns, then 3 to 1 along them with biases 8 and 7."""
    sums = F.zip_with(own, near, lambda a, b: 3 * a + b)

    def spread(c: Column) -> Column:
        n = F.size(c)

        def at(i: Column) -> Column:
            k = F.least(_half(i), n - 1)
            this, back, ahead = F.get(c, k), F.get(c, k - 1), F.get(c, k + 1)
            return F.when((n == 1) | (i == 0), shr(4 * this + 8, 4)).when(i == width - 1, shr(4 * this + 7, 4)).when(i % 2 == 0, shr(3 * this + back + 8, 4)).otherwise(shr(3 * this + ahead + 7, 4))

        return F.transform(F.sequence(F.lit(0), width - 1), at)

    return let(sums, spread)


def lossless_predict(predictor: Column, left: Column, up: Column, corner: Column) -> Column:
    """Predictors 1 to 7 of lossless JPEG, for samples off the first row and column."""
    return (F.when(predictor == 1, left).when(predictor == 2, up).when(predictor == 3, corner).when(predictor == 4, left + up - corner)
            .when(predictor == 5, left + shr(up - corner, 1)).when(predictor == 6, up + shr(left - corner, 1)).otherwise(shr(left + up, 1)))
