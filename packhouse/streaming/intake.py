"""Order intake over arriving request files, each request applied once.

A request is known by its id: one that a stored batch has decided is left out of later batches, whichever stream or
checkpoint they come from. Rows without an id cannot be known again: within a stream each is applied once, under a new
checkpoint it is applied anew. One writer at a time works on an output folder.

What a batch reads does not grow with the batches before it: applied ids are looked up in pruned runs (`applied`), the last
ids come from the state and from table rows beyond it, and streams are known by the number of their last batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packhouse.operators.features import Tables
from packhouse.operators.intake import order_intake, place_orders
from packhouse.schemas import REQUESTS
from packhouse.sources.store import children, delete, publish, read_text
from packhouse.streaming.applied import IntakeState, State


def _last_ids(tables: Tables, state: State) -> tuple[int, int]:
    """The largest ids in use, whoever gave them out. Only ids above the state's are asked for, which the statistics of stored
    tables answer without reading rows."""
    return tuple(
        tables[name].where(F.col(key) > given).agg(F.coalesce(F.max(key), F.lit(given))).first()[0]
        for name, key, given in (("shop_orders", "order_id", state.last_order),
                                 ("order_items", "order_item_id", state.last_item)))


def _base(spark: SparkSession, batch: str, tables: Tables, state: State, out_dir: str) -> tuple[int, int]:
    """The ids a batch continues from: written down when it first begins, and read again when it is repeated."""
    begun = f"{out_dir}/starts"
    for name in children(spark, begun):
        if name == batch:
            return tuple(json.loads(read_text(spark, f"{begun}/{name}")))
    base = _last_ids(tables, state)
    publish(spark, f"{begun}/{batch}", json.dumps(base) + "\n")
    return base


def apply_batch(requests: DataFrame, batch_id: int, tables: Tables, out_dir: str, stream: str = "direct") -> None:
    """Decide one batch and store its orders, lines and decisions; the state that names it comes last.

    A stream's batches come in the order of their numbers; one that is not beyond the last applied is skipped. The ids a
    batch continues from are written down before anything else, so a batch that failed half-way is written again in the same
    place with the same ids.
    """
    spark = requests.sparkSession
    batch = f"{stream}-{batch_id}"
    own = IntakeState(spark, out_dir)
    state = own.read()
    if batch_id <= state.streams.get(stream, -1):
        return
    base_order, base_item = _base(spark, batch, tables, state, out_dir)
    decided_path = f"{out_dir}/decisions/batch={batch}"
    order_intake(own.fresh(requests, state), tables["customers"], tables["products"]).write.mode("overwrite").parquet(decided_path)
    decided = spark.read.parquet(decided_path)
    orders, items = place_orders(decided, F.lit(base_order), F.lit(base_item))
    orders.write.mode("overwrite").parquet(f"{out_dir}/orders/batch={batch}")
    items.write.mode("overwrite").parquet(f"{out_dir}/items/batch={batch}")
    # Every order has a line, so the stored lines know both last ids.
    last = spark.read.parquet(f"{out_dir}/items/batch={batch}").agg(
        F.coalesce(F.max("order_id"), F.lit(base_order)), F.coalesce(F.max("order_item_id"), F.lit(base_item))
    ).first()
    own.commit(state, stream, batch_id, decided.select("request_id").where("request_id is not null"), last[0], last[1])
    delete(spark, f"{out_dir}/starts/{batch}")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream when it made the checkpoint: a new checkpoint is a new stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def intake_stream(spark: SparkSession, in_dir: str, tables: Tables, out_dir: str, checkpoint: str,
                  files_per_batch: int | None = None) -> StreamingQuery:
    """Apply all request files that arrived since the last run, then stop."""
    reader = spark.readStream.schema(REQUESTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(in_dir).writeStream
        .foreachBatch(lambda batch, batch_id: apply_batch(
            batch, batch_id, tables, out_dir, _stream_id(spark, checkpoint)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start())


def placed(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """Stored `orders`, `items` or `decisions` of the applied batches; None before the first. Folders of other batches are
    not read: the batch is the partition, and a stream's batches up to its last are applied."""
    streams = IntakeState(spark, out_dir).read().streams
    if not streams:
        return None
    stored = spark.read.option("basePath", f"{out_dir}/{name}").parquet(f"{out_dir}/{name}")
    batch = F.col("batch").cast("string")
    last = F.create_map(*[F.lit(x) for pair in streams.items() for x in pair])
    number = F.regexp_extract(batch, r"-(\d+)$", 1).cast("long")
    return stored.where(number <= last[F.regexp_extract(batch, r"^(.*)-\d+$", 1)]).drop("batch")
