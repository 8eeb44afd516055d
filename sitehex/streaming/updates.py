"""Keyed updates: versioned rows, progressive layers, one-shot commands, deletes."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitehex.sources.publish import path_exists


def append_versions(source: DataFrame, path: str, checkpoint: str, by: str = "city") -> StreamingQuery:
    """Append every version as it arrives; the next read sees it and the newest one wins there.

    The file sink commits each batch exactly once.
    """
    return (
        source.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(by)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def latest_layer_parts(writes: DataFrame) -> DataFrame:
    """Newest write per ``(session, layer)``: the same id replaces, ``rev`` tells writes apart.

    Works as a batch aggregate and, on a stream, in update mode with one row of state per layer.
    """
    payload = F.max(F.struct("seq", "rev", "label", "row_count", "route")).alias("_w")
    return writes.groupBy("session", "layer").agg(payload, F.count("*").alias("writes")).select(
        "session", "layer", "_w.rev", "_w.label", "_w.row_count", "_w.route", "writes"
    )


LAYER_COLUMNS = ("session", "layer", "rev", "label", "row_count", "route", "writes")


def maintain_layers(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest write of every layer, with one row of state for each layer.

    A micro-batch emits the layers that it touched as they stand now, so a write that comes late, behind one with a higher
    ``seq``, counts but replaces nothing. A batch owns its part and overwrites it when replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    with rocksdb(source.sparkSession):
        return (
            latest_layer_parts(source)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def current_layers(spark: SparkSession, path: str) -> DataFrame:
    """The layers as the last batch that touched each of them left it; no write is looked at again."""
    last = F.max_by(F.struct(*LAYER_COLUMNS[2:]), "batch_id").alias("_w")
    kept = spark.read.parquet(path).groupBy("session", "layer").agg(last)
    return kept.select("session", "layer", "_w.*")


#: Folders below the table of applied commands, out of sight of its readers.
INBOX, LEDGER = "_inbox", "_ledger"

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk and saved as changes; it may outgrow memory."""
    before = {name: spark.conf.get(name, None) for name in ROCKSDB}
    for name, value in ROCKSDB.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def once_per_command(commands: DataFrame, key: str = "command_id") -> DataFrame:
    """Commands, each id once: of a batch, or of all that a stream ever delivers."""
    return commands.dropDuplicates([key])


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its progress folder; another folder has another one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def deliver_commands(batch: DataFrame, path: str, sender: str, batch_id: int) -> None:
    """Put a batch into the inbox of ``path``, once for each sender and number.

    A part that is complete is not written again: a batch that is replayed holds the same rows.
    """
    part = f"{path.rstrip('/')}/{INBOX}/part={sender}-{batch_id}"
    if not path_exists(batch.sparkSession, f"{part}/_SUCCESS"):
        batch.write.mode("overwrite").parquet(part)


def settle_commands(spark: SparkSession, path: str, schema: StructType, key: str = "command_id") -> StreamingQuery:
    """Apply what lies in the inbox and was not applied before; ends when the inbox is read.

    Which ids were applied is state of one stream that belongs to the table and not to any sender: a RocksDB store,
    partitioned by the hash of the id, whose changes are saved with every batch. A batch looks up its own ids there and
    reads no earlier ones; an id is known for good, since there is no watermark. The state, the files read and the parts
    written move on together, so a lost executor or driver repeats a batch with the same outcome. The stream refuses to
    run twice at once over one table.
    """
    root = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(root)
        )

    inbox = (
        spark.readStream.schema(schema)
        .option("maxFileAge", "36500d")  # a part that waits long is not forgotten
        .option("ignoreMissingFiles", True)  # a part that was broken off is written anew under other names
        .parquet(f"{root}/{INBOX}/part=*")
    )
    with rocksdb(spark):
        return (
            once_per_command(inbox, key)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{root}/{LEDGER}")
            .trigger(availableNow=True)
            .start()
        )


def apply_commands_once(source: DataFrame, path: str, checkpoint: str, key: str = "command_id") -> StreamingQuery:
    """Append every command once per id, however late, in whichever file and through whichever stream it comes again.

    Each batch is put into the inbox of the table and settled against the table's own ledger, so streams with other
    progress folders, or with lost ones, do not apply an id again and lose none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        deliver_commands(batch, path, _stream_id(spark, checkpoint), batch_id)
        settle_commands(spark, path, batch.schema, key).awaitTermination()

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
