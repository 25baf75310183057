"""Dumps of expected reputations: JSON documents {"result": {"reputations": [{account, reputation}]}}."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votescore import schemas

ROWS_PER_DOCUMENT = 100_000


def load_dump(spark: SparkSession, path: str, accounts: DataFrame) -> DataFrame:
    """(account_id, reputation) of one document or a folder of them; unknown names get a NULL id.

    A document is one JSON value and is read by one task; large dumps come as several documents.
    """
    documents = spark.read.schema(schemas.DUMP).json(path, multiLine=True)
    rows = documents.select(F.explode("result.reputations").alias("entry")).select("entry.*")
    ids = accounts.select(F.col("name").alias("account"), F.col("id").alias("account_id"))
    return rows.join(ids, "account", "left").select("account_id", F.col("reputation").cast("long").alias("reputation"))


def write_dump(reputation: DataFrame, accounts: DataFrame, path: str,
               rows_per_document: int = ROWS_PER_DOCUMENT) -> None:
    """The same format, in as many documents as the size asks for."""
    named = reputation.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account")),
                            "account_id")
    documents = max(1, -(-reputation.count() // rows_per_document))
    entry = F.struct("account", "reputation")
    (
        named.withColumn("part", F.pmod(F.xxhash64("account"), F.lit(documents)))
        .groupBy("part").agg(F.collect_list(entry).alias("reputations"))
        .select("part", F.to_json(F.struct(F.struct("reputations").alias("result"))).alias("value"))
        .repartition(documents, "part").write.mode("error").partitionBy("part").text(path)
    )
