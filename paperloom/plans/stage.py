"""Cutting lineage: a table in the shared folder, read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # One machine alone may use its own disk; a cluster shares its warehouse.
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/paperloom-staged"
        if not local and re.match(r"file:|/", folder):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/paperloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
