"""Applying a trained detector to a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from glotsieve.plans.detect import Detector, detect_language
from glotsieve.sources.blocks import jvm_blocks


def detect_stream(
    stream: DataFrame, text: str, detector: Detector, path: str
) -> DataStreamWriter:
    """Label every micro-batch with the batch plan and write it as parquet.

    A text is judged alone, so no state is kept between batches. A batch goes
    to a folder of its own number and is overwritten if it is run again, so a
    restart from the stream's checkpoint neither loses nor doubles rows. The
    caller sets trigger and checkpoint, and starts the query.
    """

    def label(batch: DataFrame, number: int) -> None:
        blocks = jvm_blocks(batch.sparkSession)
        labelled = detect_language(batch, text, detector, blocks)
        labelled.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(label)
