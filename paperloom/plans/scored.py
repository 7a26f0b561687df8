"""Papers with all that the rules say of them, written once for queries that read them more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..functions.told import Told
from ..sources.corpus import corpus
from .corpus import chain
from .stage import staged

#: Scratch of the rules that no later relation reads.
INNER = ("hit_tags", "kept_tags")


def scored(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> Told:
    """The dialect over a folder, with the relation ``scored``, or the named columns of it, in a table of the shared folder."""
    rows = spark.sql(f"{chain(corpus(spark, sf_dir), 'scored')} SELECT {', '.join(columns or ['*'])} FROM scored").drop(*INNER)
    view = f"scored_{uuid.uuid4().hex}"
    staged(rows, "scored").createOrReplaceTempView(view)
    return Told(sf_dir, scored=view)
