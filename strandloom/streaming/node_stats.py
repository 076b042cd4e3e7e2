"""Node statistics of a growing folder of alignment files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cigar import edit_letter
from strandloom.sources.alignment_files import ALIGNMENT


def node_stats_stream(spark: SparkSession, folder: str, min_mapq: int = 6, files_per_trigger: int = 1) -> DataFrame:
    """The batch statistics as an aggregate in update or complete mode: counts and maxima need no watermark."""
    reads = spark.readStream.schema(ALIGNMENT.replace("quality binary", "quality string")).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    rows = reads.where(F.col("mapping_quality") >= min_mapq).select(F.explode("path.mapping").alias("m")).where("m.position.node_id <> 0")
    cigar = F.array_join(F.filter(F.transform("m.edit", lambda e: F.concat(F.greatest(e["from_length"], e["to_length"]).cast("string"), edit_letter(e))), lambda x: x.isNotNull()), "")
    perfect = F.forall("m.edit", lambda e: F.coalesce(edit_letter(e) == "M", F.lit(False)))
    length = F.aggregate("m.edit", F.lit(0), lambda s, e: s + e["to_length"])
    parts = rows.select(F.col("m.position.node_id").alias("node_id"), perfect.alias("perfect"), length.alias("n"), F.length(cigar).alias("c"))
    return parts.groupBy("node_id").agg(F.count_if("perfect").alias("perfect"), F.count_if(~F.col("perfect")).alias("not_perfect"), F.max("n").alias("max_read_length"), F.max("c").alias("max_cigar_length"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all files there are, with state checkpointed in the shared folder, and return the final table.

    Each batch adds the nodes that it changed, as Parquet below ``path``; a node's last version counts. A batch that runs
    again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c != "node_id"]
    versions = stream.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(path)
    return versions.groupBy("node_id").agg(F.max_by(F.struct(*values), "batch").alias("last")).select("node_id", "last.*")
