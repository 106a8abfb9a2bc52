"""Links and images of markdown texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_srcs, link_hrefs


def explode_links(df: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """(key, kind, pos, target): distinct targets by first appearance; kind is image or link."""
    found = F.map_from_arrays(F.array(F.lit("image"), F.lit("link")), F.array(image_srcs(F.col(text)), link_hrefs(F.col(text))))
    both = df.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("kind", "targets"))
    return both.select(key, "kind", F.posexplode("targets").alias("pos", "target"))
