"""Tables written once into the shared folder, so that later steps survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cueglass.operators.scale import set_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it from there.

    Unlike an RDD checkpoint the copy is compressed, and a reader takes only the
    columns it needs. The files go when the application ends.
    """
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
