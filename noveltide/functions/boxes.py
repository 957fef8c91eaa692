"""Boxes: [ymin, xmin, ymax, xmax] on a 0-1000 scale, pixels, and label lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the crop filters.
MIN_SIDE, MIN_AREA, MAX_COVER, MIN_VARIANCE = 30, 900, 0.85, 25.0


def box_to_pixels(box: Column, height: Column, width: Column) -> Column:
    """[y1, x1, y2, x2] in whole pixels: truncated, the near corner at least 0, the far one at most the image's side."""
    at = lambda i, side: (F.get(box, F.lit(i)) * side / 1000).cast("int")
    return F.array(F.greatest(at(0, height), F.lit(0)), F.greatest(at(1, width), F.lit(0)), F.least(at(2, height), height), F.least(at(3, width), width))


def box_to_center(box: Column) -> Column:
    """[cx, cy, w, h] in 0-1; a box that has not four numbers covers the whole image."""
    y1, x1, y2, x2 = (F.get(box, F.lit(i)) / 1000 for i in range(4))
    whole = F.array(*[F.lit(v) for v in (0.5, 0.5, 1.0, 1.0)])
    return F.when(F.size(box) == 4, F.array((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)).otherwise(whole)


def reject_reason(box: Column, height: Column, width: Column, variance: Column | None = None) -> Column:
    """The first filter that a box fails: box, size, zoom, empty, blur; null if it is kept. No variance keeps it.

    Box and pixels are named by lambdas: each use of an expression in a filter is worked out again, and here uses multiply.
    """

    def reason(b: Column, px: Column) -> Column:
        h, w = F.get(px, F.lit(2)) - F.get(px, F.lit(0)), F.get(px, F.lit(3)) - F.get(px, F.lit(1))
        return (
            F.when(b.isNull() | (F.size(b) != 4), "box")
            .when((w < MIN_SIDE) | (h < MIN_SIDE) | (w * h < MIN_AREA), "size")
            .when((w > MAX_COVER * width) & (h > MAX_COVER * height), "zoom")
            .when((w <= 0) | (h <= 0), "empty")
        )

    whole = lambda b, px: reason(b, px) if variance is None else reason(b, px).when(variance < MIN_VARIANCE, "blur")
    named = F.transform(F.array(box), lambda b: F.get(F.transform(F.array(box_to_pixels(b, height, width)), lambda px: whole(b, px)), F.lit(0)))
    return F.get(named, F.lit(0))


def format_label_line(class_id: Column, center: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, *[F.get(center, F.lit(i)) for i in range(4)])


def parse_label_line(line: Column) -> Column:
    """struct(n, class_id, cx, cy, w, h): n fields; null for those that are no whole or decimal number."""
    parts = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    return F.struct(
        F.when(F.trim(line) == "", 0).otherwise(F.size(parts)).alias("n"),
        F.get(parts, F.lit(0)).try_cast("int").alias("class_id"),
        *[F.get(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))],
    )


def round_detection(confidence: Column, box: Column) -> tuple[Column, Column]:
    return F.round(confidence, 4), F.transform(box, lambda v: F.round(v, 2))
