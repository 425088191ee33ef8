"""Confirmed labels to a COCO-like training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import literal_table
from ..operators.ordered import numbered


def to_coco(df: DataFrame, categories: list[str], image: str = "drawing_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) with dense ids.

    Input: ``image`` (integer key), ``ann_key`` (unique integer), ``category``, ``x y w h``.
    Ids are numbered part by part, so no task sees all annotations.
    """
    spark = df.sparkSession
    boxes = df.where(" and ".join(f"{c} is not null" for c in "xywh"))
    images = numbered(boxes.select(image).distinct(), [], [image], "id")
    images = images.select("id", image, F.concat(F.col(image).cast("string"), F.lit(".png")).alias("file_name"))
    cats = literal_table(spark, [(i + 1, c) for i, c in enumerate(categories)], "category_id long, category string")
    with_ids = (boxes.join(images.select(image, F.col("id").alias("image_id")), image)
                .join(F.broadcast(cats), "category", "left"))
    anns = numbered(with_ids, [], [image, "ann_key"], "id")
    anns = anns.select(
        "id", "image_id", F.coalesce("category_id", F.lit(0)).cast("long").alias("category_id"),
        F.col("category").alias("category_name"),
        *[F.round(c, 4).alias(c) for c in "xywh"],
        F.round(F.col("w") * F.col("h"), 6).alias("area"), F.lit(0).alias("iscrowd"))
    return images, anns, cats.select(F.col("category_id").alias("id"), F.col("category").alias("name"))


def write_coco(parts: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """One JSON-lines folder per part."""
    for name, part in zip(("images", "annotations", "categories"), parts):
        part.write.mode("overwrite").json(f"{path}/{name}")
