"""Helpers that the corpus operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words whose hashes or ids one worker keeps.
CACHE_WORDS = 100_000


class Hashes(dict):
    """XXH64 of a word (bytes), kept while the worker lives and emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and both sides of a worker's pipe hold whole batches.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session gets a new folder; a cluster has no folder of its own to fall back to.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rxweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, lets several steps read one result, and gives the optimizer the table's real size. An operator
    takes its tables away with ``drop_stored`` once what follows from them is written; those that its result reads stay until
    ``clear_stored``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_path = path
    return made


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables as ``stored`` returned them; nothing may read them any more."""
    for t in tables:
        _delete(t.sparkSession, t.stored_path)


def clear_stored(spark: SparkSession) -> None:
    """Remove all tables that ``stored`` has written in this application; results that still read them no longer work."""
    _delete(spark, shared_dir(spark))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a worker makes of a batch of long texts, and sends back at once, stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id's decimal text (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star rounds.

    ``edges`` has long columns a and b. Returns (node, root), root the smallest node of its component, for every
    node with an edge to another node. Every round is a join and an aggregate over edges and is written to the
    shared folder; no component is gathered in one task. Nulls and loops are ignored; no edges give no rows.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small-star: every node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        old, links = links, stored(both, name)
        drop_stored(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
