"""Boxes on ARRAY<STRUCT<box ARRAY<DOUBLE>, conf DOUBLE, cls STRING>> detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 0.08


def box_area(box: Column) -> Column:
    width = F.greatest(F.lit(0.0), F.get(box, F.lit(2)) - F.get(box, F.lit(0)))
    height = F.greatest(F.lit(0.0), F.get(box, F.lit(3)) - F.get(box, F.lit(1)))
    return width * height


def _padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    px, py = (x2 - x1) * PAD, (y2 - y1) * PAD
    return F.array(
        F.greatest(F.lit(0), (x1 - px).cast("int")), F.greatest(F.lit(0), (y1 - py).cast("int")),
        F.least(width.cast("int"), F.bround(x2 + px).cast("int")),
        F.least(height.cast("int"), F.bround(y2 + py).cast("int")))


def primary_box(dets: Column, width: Column, height: Column) -> Column:
    """STRUCT<box ARRAY<INT>, multi_item>. One or two boxes: their union (a pair). More: the largest, flagged."""
    n = F.coalesce(F.size(dets), F.lit(0))

    def edge(pick, i: int) -> Column:
        return pick(F.transform(dets, lambda d: F.get(d["box"], F.lit(i))))

    union = _padded(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 2), edge(F.array_max, 3),
                    width, height)
    biggest = F.array_max(F.transform(dets, lambda d: box_area(d["box"])))
    chosen = F.get(F.filter(dets, lambda d: box_area(d["box"]) == biggest), F.lit(0))["box"]
    largest = _padded(*[F.get(chosen, F.lit(i)) for i in range(4)], width, height)
    return F.struct(F.when(n > 2, largest).when(n > 0, union).alias("box"), (n > 2).alias("multi_item"))


def pixel_area(box: Column) -> Column:
    area = (F.get(box, F.lit(2)) - F.get(box, F.lit(0))) * (F.get(box, F.lit(3)) - F.get(box, F.lit(1)))
    return F.coalesce(area, F.lit(0))
