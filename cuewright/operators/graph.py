"""Connected components of labels, by rounds over tables of links."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that cut() wrote and that are still there.
_written: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share and read back, which cuts its lineage.

    The folder is the one that spark.checkpoint.dir names; only a local master may do
    without the setting. The table goes when the process ends, or by discard().
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cuewright-")
        context.setCheckpointDir(folder)
    path = f"{folder}/cuewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() gave and that nothing reads any more."""
    for t in tables:
        _delete(_written.pop(t._written_path), t._written_path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def least_labels(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, least: for labels in links (keys, a, b) the least one that links lead to inside equal keys; least labels themselves have no row.

    Links point from the greater to the smaller label. A round first links all greater
    neighbours of a label to the least one around it, then all smaller ones, so links
    never get more and chains shorten by half; a round that changes none has found
    stars around the least labels. All links stay in tables, written after each round.
    """

    def rehung(rows: DataFrame, kept: str) -> DataFrame:
        """a's neighbours b where `kept` holds, and their least m, as links from b and a to m."""
        least = rows.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return rows.join(least, [*keys, "a"]).where(kept)

    turned = lambda t: t.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    state = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first()
    links = cut(links.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(links)
    while True:
        large = rehung(links.unionByName(turned(links)), "b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = rehung(large, "true")
        small = small.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(*keys, "a", F.col("m").alias("b")))
        spent, links = links, cut(small.where("a <> b").distinct())
        discard(spent)
        after = state(links)
        if after == before:
            return links.select(*keys, F.col("a").alias("label"), F.col("b").alias("least"))
        before = after
