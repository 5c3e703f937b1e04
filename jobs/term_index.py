"""Keep a term index over a growing folder of documents.

Whoever searches a corpus that grows every day needs its postings without reading old texts again. The job is a file stream with
`availableNow`: Spark's checkpoint knows which files were read, a run takes those that came since, and ends. Each micro-batch writes

* `postings`: term, doc_id, tf, dl, partitioned by batch and by a bucket of the term (a search reads its terms' buckets only), and
* `documents`: doc_id, dl, lang, source, partitioned by batch.

A batch that runs again after a failure has the same files and number, and replaces its own partitions. A document that comes again is
a new version: the one of the latest batch counts (within a batch that of the file changed last, then of the last name, then the greater
text). `current` reads the postings that count, `statistics` the number and mean length of documents.

Rows without doc_id are left out and counted in the log. Null and empty texts are documents without terms.
"""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions.text import tokenize
from ctxspark.operators import bm25
from ctxspark.plans import sql
from jobs import common

log = logging.getLogger("term_index")

POSTINGS = "term string, doc_id long, tf long, dl int, batch long, bucket int"
DOCUMENTS = "doc_id long, dl int, lang string, source string, batch long"
SOURCE = "doc_id long, text string, lang string, source string"
COLUMNS = ["doc_id", "text", "lang", "source"]


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _adder(output: str, buckets: int):
    def add(batch: DataFrame, number: int) -> None:
        seen = batch.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
        rest = [c for c in batch.columns if c != "doc_id"]
        version = F.max_by(F.struct(*rest), F.struct("changed", "file", F.coalesce("text", F.lit(""))))
        docs = batch.where("doc_id is not null").groupBy("doc_id").agg(version.alias("d")).select("doc_id", "d.text", "d.lang", "d.source")
        own = docs.select("doc_id", "lang", "source", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"), F.lit(number).cast("long").alias("batch"))
        own = own.persist(StorageLevel.DISK_ONLY)  # two tables come from it
        try:
            found = bm25.postings(own, "doc_id").withColumn("batch", F.lit(number).cast("long")).withColumn("bucket", bucket_of("term", buckets))
            # ranges grow with what is in them, so a bucket with a frequent term is many tasks' and files'
            dealt = found.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id")
            _write(dealt, f"{output}/postings", "batch", "bucket")
            # these make the batch's postings count, so they come last
            _write(own.select("doc_id", F.size("tokens").alias("dl"), "lang", "source", "batch"), f"{output}/documents", "batch")
            written = own.count()
        finally:
            own.unpersist()
        log.info("batch %d: read %d rows, %d without doc_id; wrote %d documents to %s", number, seen["rows"], seen["rows"] - seen["named"], written, output)

    return add


def run(spark: SparkSession, source: str, output: str, checkpoint: str, buckets: int = 16, files_per_batch: int = 1000) -> DataFrame:
    """Take in what is new under source; returns the postings that count."""
    for table, kinds, by in (("postings", POSTINGS, ["batch", "bucket"]), ("documents", DOCUMENTS, ["batch"])):
        # so that an index of nothing can be read as well
        spark.createDataFrame([], kinds).write.mode("ignore").partitionBy(*by).parquet(f"{output}/{table}")
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = stream.select(*COLUMNS, F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    query = rows.writeStream.foreachBatch(_adder(output, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    counts = statistics(spark, output).first()
    log.info("%s is taken in; the index has %d documents, mean length %.1f", source, counts["n"], counts["mean"] or 0)
    return current(spark, output)


def _documents(spark: SparkSession, output: str) -> DataFrame:
    rows = spark.read.schema(DOCUMENTS).parquet(f"{output}/documents")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("dl", "lang", "source", "batch"), "batch").alias("d")).select("doc_id", "d.*")


def statistics(spark: SparkSession, output: str) -> DataFrame:
    return _documents(spark, output).agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))


def current(spark: SparkSession, output: str) -> DataFrame:
    """doc_id, term, tf, dl of each document's latest version."""
    postings = spark.read.schema(POSTINGS).parquet(f"{output}/postings")
    return postings.join(_documents(spark, output).select("doc_id", "batch"), ["doc_id", "batch"]).select("doc_id", "term", "tf", "dl", "bucket")


def ask(spark: SparkSession, output: str, question: str, k: int = 10, buckets: int = 16) -> DataFrame:
    """The k best documents of a question, from its terms' buckets alone."""
    terms = bm25.query_tokens(spark, question)
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of("term", buckets)).distinct().collect()]
    counts = statistics(spark, output).first()
    found = bm25.bm25_postings(current(spark, output).where(F.col("bucket").isin(wanted)), terms, counts["n"], counts["mean"], "doc_id")
    return found.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def job1_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice over all documents, into a new folder; the second run finds nothing new."""
    folder = common.new_folder(spark, "job1")
    for _ in range(2):
        # the table may be a folder or one file, which file streams take only by a pattern
        found = run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/index", f"{folder}/checkpoint")
    return found.select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


SQL = f"""
WITH d AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, {sql.tokens('text')} AS tokens FROM d)
SELECT doc_id, term, count(*) AS tf, dl FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM t) GROUP BY doc_id, term, dl
"""

if __name__ == "__main__":
    common.main("term index", run, common.settings(__doc__, ["source", "output", "checkpoint"]))
