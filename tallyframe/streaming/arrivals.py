"""Incremental refresh: facts that arrive as files are stored and the companies they concern recomputed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.refresh import refresh
from ..sources.store import TableStore


def store_batch(spark: SparkSession, store: TableStore, batch: DataFrame, key: Sequence[str] = ("id",), then: Callable = refresh) -> list[int]:
    """Upsert one batch of facts by key and refresh its companies, whose ids are returned.

    Of several rows of one key the one with the greatest columns (in their order) holds, so that a repeated batch ends in the same state.
    """
    batch = batch.groupBy(*key).agg(F.max(F.struct(*[c for c in batch.columns if c not in key])).alias("__r")).select(*key, "__r.*").select(batch.columns)
    companies = sorted(r.company_id for r in batch.select("company_id").where("company_id is not null").distinct().collect())  # ids of companies, not rows
    if companies:
        store.upsert("financial_facts", batch, key)
        then(spark, store, companies)
    return companies


def follow_arrivals(spark: SparkSession, folder: str, schema: StructType, store: TableStore, checkpoint: str, then: Callable = refresh) -> StreamingQuery:
    """A streaming query over Parquet files arriving in `folder`; it ends when all that is there has been handled.

    A batch that is repeated after a failure leaves the same state, since rows are upserted by key and companies recomputed whole.
    """
    arriving = spark.readStream.schema(schema).parquet(folder)
    return (
        arriving.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: store_batch(batch.sparkSession, store, batch, then=then)).start()
    )
