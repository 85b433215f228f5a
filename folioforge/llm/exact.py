"""Exact deduplication by keyed streaming state.

A structured stream over the documents keeps, for every digest ever seen, the row that stays (smallest doc_id, then its
place), where its content lies (file and row in it), and a count. The state is on disk (RocksDB), lives in the stream's
checkpoint and never expires: give `duplicates` a checkpoint of your own, and a later run over new documents goes on from
it. A digest that was hit is no proof: the full bytes of all rows under it are compared, and rows that differ are told apart.

Null and empty texts are equal. Of rows that repeat a doc_id and text, one stays. A null doc_id orders last. Extra
columns, of any name, are ignored, and stay in keep_first. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE_RUN, looked_up, shared_path, sieved, staged

#: Rows of a new run for each partition of its state, some ten megabytes.
ROWS = 50_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame) -> DataFrame:
    """doc_id and text with locator and row: the file of a row and its number there, the same on every read.

    A table that doesn't come from files has no such place; its rows are numbered as they are read.
    """
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("locator"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit("").alias("locator"), F.monotonically_increasing_id().alias("row"))


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None) -> DataFrame:
    """doc_id, row, locator, digest, text_sha256; written once to the shared folder, or added to `folder`."""
    norm = normalised()
    rows = located(docs).select("doc_id", "row", "locator", sha256(norm).alias("text_sha256"), digest(norm).alias("digest"))
    if folder is None:
        return staged(rows, "digests")
    run = F.lit(uuid.uuid4().hex)
    rows.withColumn("run", run).write.mode("append").parquet(folder)
    return docs.sparkSession.read.parquet(folder).filter(F.col("run") == run).drop("run")


def keyed_state(rows: DataFrame, checkpoint: str, folder: str | None = None, files_per_batch: int = 10_000, partitions: int | None = None) -> DataFrame:
    """Stream rows (a DataFrame read from files) through the state at checkpoint; the state after it.

    partitions: of a new state; that of an old one stays. Stores are closed when their batch is committed.
    Columns: digest, first (order, doc_id, row, locator of the row that stays), n (rows seen).
    """
    spark = rows.sparkSession
    path = folder or rows.inputFiles()[0].rsplit("/", 1)[0]
    key = "spark.sql.streaming.stateStore.providerClass"
    conf = {key: ROCKS, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.unloadOnCommit": "true", "spark.sql.streaming.stateStore.maintenanceInterval": "5s"}
    conf |= {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        first = F.min(place()).alias("first")
        seen = stream.groupBy("digest").agg(first, F.count("*").alias("n"))
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        names = state.schema["value"].dataType.names
        kept = state.select(F.col("key")[state.schema["key"].dataType.names[0]].alias("digest"), F.col("value")[names[0]].alias("first"), F.col("value")[names[1]].alias("n"))
        return staged(kept, "state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "locator", "row")


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """For each row: doc_id, row, locator, keep_id, keep_locator, group_size, kept, text_sha256.

    With a checkpoint, rows that earlier runs with it have seen count too, and the row that stays may be one of theirs;
    its bytes are then read where they lie. Digests of all runs are beside the checkpoint. A run that failed is not to be
    repeated with the same checkpoint if it had begun to stream.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint}-rows" if checkpoint else None
    rows = digests(docs, digest, folder)
    total = rows.count()
    if not total:
        return rows.select("doc_id", "row", "locator", F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_locator"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    state = keyed_state(rows, checkpoint or shared_path(spark, "exact-state"), folder, partitions=max(1, -(-total // ROWS))).withColumnRenamed("digest", "d")

    def told(x: DataFrame, first: str, n: str) -> DataFrame:
        own = (F.col("row") == F.col(f"{first}.row")) & (F.col("locator") == F.col(f"{first}.locator"))
        return x.select("doc_id", "row", "locator", F.col(f"{first}.doc_id").alias("keep_id"), F.col(f"{first}.locator").alias("keep_locator"), F.col(n).alias("group_size"), own.alias("kept"), "text_sha256")

    hits = state.filter("n > 1")
    texts = located(docs)
    if checkpoint and (files := set(r[0] for r in hits.select("first.locator").distinct().collect() if r[0]) - set(docs.inputFiles())):  # at most the files of earlier runs
        kept = hits.select(F.col("first.locator").alias("l"), F.col("first.row").alias("r"))
        old = located(spark.read.parquet(*sorted(files)))
        texts = texts.unionByName(old.join(kept, (F.col("locator") == F.col("l")) & (F.col("row") == F.col("r")), "left_semi"))
    mixed = differing(texts, hits, digest)
    if mixed.isEmpty():
        return told(looked_up(rows, state, "digest", "d", "n", total), "first", "n")
    # Different texts under one digest: the group of a row is its bytes. Rows are few, or the digest is a poor one.
    full = texts.withColumn("norm", normalised()).withColumn("digest", digest(F.col("norm"))).drop("text")
    full = full.join(mixed, "digest", "left_semi").withColumn("text_sha256", sha256(F.col("norm")))
    groups = full.groupBy("norm").agg(F.min(place()).alias("own"), F.count("*").alias("m")).withColumnRenamed("norm", "bytes")
    full = full.join(rows.select(F.col("locator").alias("l"), F.col("row").alias("r")), (F.col("locator") == F.col("l")) & (F.col("row") == F.col("r")), "left_semi") if checkpoint else full
    fixed = told(full.join(groups, F.col("norm") == F.col("bytes")), "own", "m")
    rest = rows.join(mixed, "digest", "left_anti")
    return told(looked_up(rest, state, "digest", "d", "n", total), "first", "n").unionByName(fixed)


def differing(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests among hits (d) whose rows don't all hold the same bytes.

    Full texts are compared where they lie: rows that no hit can hold stay out by a bit filter, and each task brings the
    others down to their distinct texts before they move, so a group of any size moves as one text from each task.
    """
    norm = normalised()
    hits = hits.select(F.col("d").alias("digest"))
    full = sieved(docs.select(digest(norm).alias("digest"), norm.alias("norm")), F.xxhash64("digest"), hits.select(F.xxhash64("digest").alias("k"))).filter("maybe")
    texts = full.groupBy("digest", "norm").agg(F.count("*").alias("n")).join(hits, "digest", "left_semi")
    return staged(texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "differing")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an earlier row has; all columns stay, whatever their names.

    Only rows that may have to go are shuffled, in full; the others stay where they are.
    """
    found = duplicates(docs)
    gone = staged(found.filter("not kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("gone")), "gone")
    stays = found.filter("kept").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"))
    key = F.xxhash64("doc_id", "sha")
    rows = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", sha256(normalised()).alias("sha"))
    rows = sieved(rows, key, gone.select(F.xxhash64("doc_id", F.col("text_sha256").alias("sha")).alias("k")))
    some = rows.filter("maybe").join(gone.withColumnsRenamed({"doc_id": "d", "text_sha256": "s"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left").drop("d", "s")
    # of rows that share doc_id and text, one stays if it is the first of its text
    w = Window.partitionBy("doc_id", "sha").orderBy("whole.text")
    some = some.withColumn("at", F.when(F.col("gone").isNotNull(), F.row_number().over(w)).otherwise(F.lit(0)))
    first = some.filter("at = 1").join(stays, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left_semi")
    return rows.filter("not maybe").select("whole.*").unionByName(some.filter("at = 0").select("whole.*")).unionByName(first.select("whole.*"))
