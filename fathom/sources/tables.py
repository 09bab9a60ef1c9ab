"""Reading of the Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Most rows of a configuration or of a set of queries that a join may broadcast.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files give fewer tasks than there are cores, as a small table of one row group does; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df marked for broadcasting if it has at most `most` rows, which are counted; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; in a local session that doesn't set it, a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/index-{uuid.uuid4().hex}"
