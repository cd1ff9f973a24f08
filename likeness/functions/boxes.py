"""Boxes of faces and bodies: structs of left, top, right, bottom."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A body against its face, the least crop and the least face in pixels.
BODY_WIDTH, BODY_ABOVE, BODY_BELOW = 3.2, 0.6, 4.5
LEAST_CROP = 96
LEAST_FACE = 40


def short_side(box: Column) -> Column:
    return F.least(box["right"] - box["left"], box["bottom"] - box["top"])


def body_box(face: Column, width: Column, height: Column) -> Column:
    """The body below a face, cut to the image and to whole pixels."""
    w, h = (F.greatest(face[b] - face[a], F.lit(1.0)) for a, b in (("left", "right"), ("top", "bottom")))
    middle, half = (face["left"] + face["right"]) / 2, w * BODY_WIDTH / 2
    whole = lambda c: c.cast("int")  # noqa: E731  towards zero
    return F.struct(
        whole(F.greatest(F.lit(0.0), middle - half)).alias("left"), whole(F.greatest(F.lit(0.0), face["top"] - h * BODY_ABOVE)).alias("top"),
        whole(F.least(width.cast("double"), middle + half)).alias("right"), whole(F.least(height.cast("double"), face["bottom"] + h * BODY_BELOW)).alias("bottom"),
    )


def box_text(box: Column) -> Column:
    return F.array_join(F.transform(F.array(*[box[k] for k in ("left", "top", "right", "bottom")]), lambda x: x.cast("int").cast("string")), ",")
