"""Continuous intake: the batch parse applied to a stream of raw experiments.

The parser is a column expression without state, so it needs no watermark; each
micro-batch is parsed once and split into accepted and rejected rows.
"""

from pyspark.sql import functions as F

from cermetry.operators.parsing import composition_columns, split_parsed

RAW = "exp_id bigint, source_id string, raw_composition string"


def raw_stream(spark, folder, schema=RAW, files_per_batch=1000):
    """New CSV files of a folder as a stream."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def start_intake(stream, target, checkpoint, once=True):
    """Write ``target/compositions`` and ``target/rejected``.

    Each batch overwrites its own subfolder, so a batch replayed after a lost
    executor or driver leaves no duplicates.
    """

    def write(batch, batch_id):
        batch = batch.persist()
        composition_columns(batch).drop("binder").write.mode("overwrite").parquet(f"{target}/compositions/batch={batch_id}")
        _, rejected = split_parsed(batch)
        rejected.withColumn("reason", F.lit("no known format")).write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
