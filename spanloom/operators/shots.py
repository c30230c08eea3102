"""Change points of a frame feature series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan as sc
from .greedy import greedy_line

KEY = ["source_id"]


@dataclass(frozen=True)
class ShotOptions:
    """Fixed values of the change rule."""

    min_change: float = 12.0
    relative: float = 3.0
    outside_mean: float = 8.0
    outside_share: float = 0.08
    spacing: int = 15


def change_points(signal: DataFrame, options: ShotOptions = ShotOptions(), *, block_frames: int = 4096) -> DataFrame:
    """Frames that stand out against the two neighbours on each side.

    ``signal`` has ``frame, v0, v1, v2``. The outcome is ``cut``, ``too_close`` to
    a stronger cut, or ``suppressed`` by a change outside the region of interest.
    """
    block = sc.by_rows("frame", block_frames)
    v = F.col("v0")
    one = sc.scan(signal, KEY, ["frame"], block, a1=sc.previous(v), b1=sc.following(v))
    two = sc.scan(one, KEY, ["frame"], block, a2=sc.previous(F.col("a1")), b2=sc.following(F.col("b1")))
    near = [F.col(c) for c in ("a1", "a2", "b1", "b2")]
    total = sum((F.coalesce(c, F.lit(0)) for c in near), F.lit(0))
    count = sum((c.isNotNull().cast("int") for c in near), F.lit(0))
    mean = total / F.greatest(count, F.lit(1))
    found = two.where((v >= options.min_change) & (v >= F.greatest(mean, F.lit(0.01)) * options.relative)).select(
        "source_id", "frame", "v0", ((F.col("v1") >= options.outside_mean) & (F.col("v2") >= options.outside_share)).alias("masked"))
    fate = greedy_line(found.where("NOT masked"), KEY, [-v, F.col("frame")], "frame", start="frame", end="frame",
                       spacing=options.spacing, stretch=65_536)
    kept = fate.select("source_id", "frame", F.when(F.col("retained"), "cut").otherwise("too_close").alias("outcome"))
    return kept.unionByName(found.where("masked").select("source_id", "frame", F.lit("suppressed").alias("outcome")))
