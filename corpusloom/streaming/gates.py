"""An extension: the gates over a stream of documents, batch by batch, with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import overlap


def residue_flags(stream: DataFrame, reference: DataFrame, out: str, checkpoint: str, n: int = overlap.NGRAM) -> StreamingQuery:
    """Write (doc_id, hits) of each micro-batch's documents that share n-grams with the reference. A batch's folder carries its
    number and is overwritten when the batch is run again, so a restart repeats nothing."""

    def one(batch: DataFrame, number: int) -> None:
        hits = overlap.residue_hits(batch, reference, n).groupBy("doc_id").agg(F.count("*").alias("hits"))
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
