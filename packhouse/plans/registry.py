"""The registered queries: each runs one operator over the star-schema test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packhouse.functions.scalars import customer_age, hash_score_at, time_text
from packhouse.operators import directory, features, intake, maintained, metrics, model, orders, quality, queue, runlog, scoring, split
from packhouse.plans.parameters import DIGITS, FRAUD_PARAMETERS, LATER_TS, RUN_TS, SEARCH_TEXTS
from packhouse.schemas import FRAUD_FEATURES, FRAUD_LABEL, REQUESTS
from packhouse.sources.shared import materialize, new_folder
from packhouse.sources.star import StarTables
from packhouse.sources.store import VersionedStore
from packhouse.streaming.intake import intake_stream, placed

def present(df: DataFrame) -> DataFrame:
    """Round doubles and write times as text, so that results compare across engines."""
    def shown(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            # Adding zero turns a negative zero into zero.
            # By way of decimals, as binary halves and last bits that depend on the order of addition would decide ties.
            exact = F.round(column.try_cast(f"decimal(38,{DIGITS + 3})"), DIGITS).cast("double")
            return (F.coalesce(exact, F.round(column, DIGITS)) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(field.dataType, T.BooleanType):
            return column.cast("int").alias(field.name)
        return column
    return df.select(*[shown(f) for f in df.schema.fields])


def _slim(star: StarTables) -> dict[str, DataFrame]:
    """Logical tables for queries that use neither line nor shipment ids."""
    return {
        "customers": star.customers, "products": star.products, "shop_orders": star.labeled_orders,
        "order_items": star.items, "shipments": star.shipped, "order_predictions": star.order_predictions,
    }


Query = Callable[[StarTables], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name; a trailing underscore avoids a clash and is dropped."""
    _QUERIES[function.__name__.rstrip("_")] = function
    return function


@query
def customers_list(star):
    return directory.customers_list(star.customers)


@query
def products_list(star):
    return directory.products_list(star.products)


@query
def customer_search(star):
    return directory.customer_search(star.customers, SEARCH_TEXTS)


@query
def customer_search_table(star):
    needles = star.raw("supplier").select(F.concat(F.lit(" "), F.regexp_extract("s_name", "#(.*)$", 1)).alias("needle"))
    return directory.customer_search(star.customers, needles)


@query
def customer_resolve(star):
    requests = star.order_requests.select("request_id", "customer_ref")
    return directory.customer_resolve(requests, star.customers, "form")


@query
def customer_resolve_session(star):
    requests = star.order_requests.select("request_id", "customer_ref")
    return directory.customer_resolve(requests, star.customers, "session")


@query
def product_price(star):
    asked = star.raw("lineitem").select((F.col("l_partkey") * 2 + 1).alias("product_id"))
    return directory.product_price(asked, star.products)


@query
def open_orders(star):
    return orders.open_orders(star.shop_orders, star.shipped)


@query
def open_orders_for_scoring(star):
    return orders.open_orders_for_scoring(star.shop_orders, star.shipped)


@query
def order_ownership(star):
    return orders.order_ownership(star.order_claims, star.shop_orders)


@query
def order_header(star):
    return orders.order_header(star.order_claims, star.shop_orders, star.items)


@query
def fulfillment_status(star):
    return orders.order_counts(star.shop_orders.select("order_id"), star.items, star.shipped).select(
        "order_id", orders.fulfillment_status(F.col("shipment_count")).alias("status"))


@query
def customer_order_stats(star):
    return orders.customer_order_stats(star.customers, star.shop_orders)


@query
def order_counts(star):
    return orders.order_counts(star.shop_orders.select("order_id"), star.items, star.shipped)


@query
def customer_order_counts(star):
    return orders.customer_order_counts(star.shop_orders)


@query
def warehouse_priority_queue(star):
    return queue.warehouse_priority_queue(
        star.shop_orders, star.customers, star.shipped, star.order_predictions)


@query
def fraud_flagged_open_orders(star):
    return queue.fraud_flagged_open_orders(
        star.shop_orders, star.customers, star.shipped, star.order_predictions)


@query
def customer_recent_orders(star):
    return orders.customer_recent_orders(star.shop_orders, star.items, star.shipped)


@query
def customer_orders(star):
    return orders.customer_orders(star.shop_orders, star.items, star.shipped, ordered=False)


@query
def order_line_items(star):
    return orders.order_line_items(star.order_items, star.products, ordered=False)


@query
def customer_overview(star):
    overview = orders.customer_overview(star.customers, star.shop_orders, star.items, star.shipped)
    lines = F.transform("recent_orders", lambda o: F.concat_ws(
        ":", o["order_id"].cast("string"), time_text(o["order_datetime"]), o["item_count"].cast("string"),
        o["shipment_count"].cast("string"), o["status"]))
    return overview.withColumn("recent_orders", F.concat_ws(",", lines))


@query
def item_aggregates_serving(star):
    return features.item_aggregates_serving(star.items, star.products)


@query
def item_aggregates_training(star):
    return features.item_aggregates_training(star.items, star.products)


@query
def label_distribution(star):
    return features.label_distribution(star.labeled_orders, FRAUD_LABEL)


@query
def feature_summary(star):
    return features.feature_summary(features.fraud_features_training(_slim(star)), FRAUD_FEATURES)


@query
def fraud_features_serving(star):
    return features.fraud_features_serving(_slim(star))


@query
def fraud_features_training(star):
    return features.fraud_features_training(_slim(star))


@query
def late_delivery_features(star):
    return features.late_delivery_features(
        {"shop_orders": star.shop_orders, "order_items": star.items, "shipments": star.shipments})


@query
def customer_age_(star):
    joined = features.lookup_join(
        star.shop_orders.select("order_id", "customer_id", "order_datetime"), "customer_id",
        [(star.customers.select("customer_id", "birthdate"), "left")])
    return joined.select(
        "order_id", customer_age(F.col("order_datetime"), F.col("birthdate")).alias("customer_age"))


@query
def stratified_split(star):
    return split.mark_split(star.labeled_orders.select("order_id", FRAUD_LABEL), FRAUD_LABEL, "order_id")


def _training(star: StarTables) -> DataFrame:
    return materialize(features.fraud_features_training(_slim(star)), "features")


@query
def median_impute(star):
    rows = _training(star)
    return model.median_impute(rows, FRAUD_FEATURES, model.medians(rows, FRAUD_FEATURES))


@query
def standard_scale(star):
    rows = _training(star)
    filled = model.median_impute(rows, FRAUD_FEATURES, model.medians(rows, FRAUD_FEATURES))
    return model.standard_scale(filled, FRAUD_FEATURES, model.scale_parameters(filled, FRAUD_FEATURES))


@query
def balanced_weights(star):
    return model.balanced_weights(star.labeled_orders.select("order_id", FRAUD_LABEL), FRAUD_LABEL)


def _fitted(star: StarTables):
    train, test = split.stratified_split(_training(star), FRAUD_LABEL, "order_id")
    return model.fit_logistic(train, FRAUD_FEATURES, FRAUD_LABEL), test


@query
def fit_logistic(star):
    fitted, test = _fitted(star)
    scored = model.predict(fitted, test, strict=True).select(FRAUD_LABEL, "prob", "pred")
    return metrics.binary_metrics(materialize(scored, "scored"), FRAUD_LABEL)


@query
def model_card(star):
    """A training run with model, metrics and card stored; the card read back."""
    path = new_folder(star.spark, "trained")
    model.train_and_store(_training(star), FRAUD_FEATURES, FRAUD_LABEL, "order_id", path, "fraud_detection_pipeline", RUN_TS,
                          training_data="mapped orders")
    card = star.spark.read.json(f"{path}/metadata")
    return card.withColumn("features", F.array_join(F.lit(model.load_features(star.spark, path)), ",")).select(
        "model_name", "model_version", "trained_at_utc", "training_data", "num_training_rows", "num_test_rows", "features", "label")


@query
def model_smoke_check(star):
    fitted, test = _fitted(star)
    path = new_folder(star.spark, "model")
    model.save_model(fitted, path)
    return model.model_smoke_check(path, test)


@query
def late_delivery_evaluate(star):
    return model.late_delivery_evaluate(
        {"shop_orders": star.shop_orders, "order_items": star.items, "shipments": star.shipments})


@query
def binary_metrics(star):
    return metrics.binary_metrics(materialize(star.predictions_labeled, "scored"))


@query
def classification_report(star):
    return metrics.classification_report(star.predictions_labeled)


@query
def hash_score_(star):
    return star.shop_orders.select("order_id", hash_score_at(
        F.col("order_id"), F.col("customer_id"), F.col("order_total"), F.col("order_datetime")).alias("score"))


@query
def score_open_orders_hash(star):
    return scoring.score_open_orders_hash(_slim(star))


@query
def score_open_orders_model(star):
    return scoring.score_open_orders_model(_slim(star), FRAUD_PARAMETERS)


@query
def upsert_predictions(star):
    """A batch that repeats orders: a third of them with a later sequence and half the score, a fifth without sequence. It
    is merged into the parts of a store, then once more."""
    scored = scoring.score_open_orders_hash(_slim(star)).withColumn("seq", F.lit(1))
    later = scored.where("order_id % 3 = 0").withColumns(
        {"seq": F.lit(2), "fraud_probability": F.col("fraud_probability") / 2, "predicted_fraud": F.lit(0)})
    unknown = scored.where("order_id % 5 = 0").withColumns(
        {"seq": F.lit(None).cast("int"), "fraud_probability": F.lit(1.0), "predicted_fraud": F.lit(1)})
    batch = materialize(scored.unionByName(later).unionByName(unknown), "batch")
    store = VersionedStore(star.spark, new_folder(star.spark, "predictions"))
    for _ in range(2):
        store.merge(batch, "order_id", lambda old, new: scoring.upsert_predictions(old, new, RUN_TS, "seq"), star.order_predictions)
    return store.read()


def _scoring_run(star: StarTables) -> scoring.ScoringRun:
    store = VersionedStore(star.spark, new_folder(star.spark, "predictions"))
    return scoring.scoring_run(star.spark, _slim(star), scoring.HashScorer(), RUN_TS, store)


@query
def scoring_run(star):
    return _scoring_run(star).flagged


@query
def scoring_run_summary(star):
    return _scoring_run(star).summary


@query
def daily_scoring(star):
    """The operational tables are stored, read back and scored twice for one time by the scorer of a shared database."""
    folder = new_folder(star.spark, "shop")
    for name, table in star.operational().items():
        table.write.parquet(f"{folder}/{name}")
    scorer = scoring.choose_scorer({"mock": scoring.HashScorer(), "python": scoring.ModelScorer(FRAUD_PARAMETERS)}, None, True)
    for _ in range(2):
        scoring.daily_scoring(star.spark, folder, scorer, RUN_TS)
    return VersionedStore(star.spark, f"{folder}/_predictions").read()


def _changed_orders(star: StarTables) -> maintained.Rollup:
    """Orders arrive, some with a wrong total and too late a date; those are corrected and the missing ones added, which is
    delivered twice; then some orders are deleted."""
    rollup = maintained.customer_rollup(VersionedStore(star.spark, new_folder(star.spark, "customer_rollup")))
    all_orders = star.shop_orders
    wrong = all_orders.where("order_id % 10 <> 3 and order_id % 7 = 0").withColumns(
        {"order_total": F.col("order_total") * 2, "order_datetime": F.col("order_datetime") + F.expr("interval 3 years")})
    first = all_orders.where("order_id % 10 <> 3 and order_id % 7 <> 0").unionByName(wrong)
    second = maintained.deleted(wrong).unionByName(
        maintained.inserted(all_orders.where("order_id % 10 = 3 or order_id % 7 = 0")))
    rollup.apply(maintained.inserted(first), "orders", 1, first)
    for _ in range(2):
        rollup.apply(second, "orders", 2, all_orders)
    rollup.apply(maintained.deleted(all_orders.where("order_id % 11 = 5")), "orders", 3, all_orders.where("order_id % 11 <> 5"))
    return rollup


@query
def customer_order_stats_maintained(star):
    return maintained.customer_order_stats(star.customers, _changed_orders(star))


@query
def customer_order_counts_maintained(star):
    return maintained.customer_order_counts(_changed_orders(star))


@query
def order_counts_maintained(star):
    """Lines and shipments arrive in two batches each, the second one twice; then the lines of some products are deleted."""
    lines = maintained.line_rollup(VersionedStore(star.spark, new_folder(star.spark, "line_rollup")))
    shipments = maintained.shipment_rollup(VersionedStore(star.spark, new_folder(star.spark, "shipment_rollup")))
    for rollup, rows in (lines, star.items), (shipments, star.shipped):
        rollup.apply(maintained.inserted(rows.where("order_id % 4 <> 1")), "arrivals", 1)
        for _ in range(2):
            rollup.apply(maintained.inserted(rows.where("order_id % 4 = 1")), "arrivals", 2)
    lines.apply(maintained.deleted(star.items.where("product_id % 9 = 0")), "arrivals", 3)
    return maintained.order_counts(star.shop_orders.select("order_id"), lines, shipments)


@query
def scoring_by_change(star):
    """A first run before some totals were corrected, while some orders were still open and others closed that were opened
    again; a later run over the tables as they are; and one more, which finds nothing to do."""
    tables = _slim(star)
    raised = F.when(F.col("order_id") % 5 == 0, F.col("order_total") + 100).otherwise(F.col("order_total"))
    closed = star.shop_orders.where("order_id % 7 = 0").select("order_id")
    before = tables | {"shop_orders": tables["shop_orders"].withColumn("order_total", raised),
                       "shipments": tables["shipments"].where("order_id % 11 <> 0").unionByName(closed)}
    store = VersionedStore(star.spark, new_folder(star.spark, "predictions"))
    digests = VersionedStore(star.spark, new_folder(star.spark, "digests"))
    for state, when in (before, RUN_TS), (tables, LATER_TS), (tables, LATER_TS):
        scoring.scoring_by_change(state, scoring.HashScorer(), when, store, digests)
    return store.read()


@query
def order_lines_parse(star):
    return intake.order_lines_parse(star.order_requests)


@query
def order_intake(star):
    """Every request comes a second time, a day later and without lines: the first delivery counts."""
    later = star.order_requests.withColumn("requested_at", F.col("requested_at") + F.expr("interval 1 day")).withColumn(
        "order_lines", F.lit("[]"))
    decided = intake.order_intake(star.order_requests.unionByName(later), star.customers, star.products)
    return decided.select(
        "request_id", "requested_at", "customer_id", "status", "order_total",
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"))


def _with_orders(new_items: DataFrame, new_orders: DataFrame) -> DataFrame:
    return new_items.join(new_orders, "order_id").select(
        "order_id", "request_id", "customer_id", "order_datetime", "order_total", "risk_score",
        "order_item_id", "product_id", "quantity", "unit_price", "line_total")


@query
def place_orders(star):
    decided = intake.order_intake(star.order_requests, star.customers, star.products)
    new_orders, new_items = intake.place_orders(
        decided, intake.last_id(star.shop_orders, "order_id"), intake.last_id(star.order_items, "order_item_id"))
    return _with_orders(new_items, new_orders)


@query
def cart_preview(star):
    return intake.cart_preview(star.order_requests, star.products)


@query
def intake_stream_(star):
    """The requests arrive in time order in three parts, each picked up by a restarted stream. The second part brings the
    first one's requests again, and the last restart has a new checkpoint, so that all files are read again."""
    spark = star.spark
    base = new_folder(spark, "stream")
    tables = {"customers": star.customers, "products": star.products,
              "shop_orders": star.shop_orders, "order_items": star.order_items}
    first, last = star.order_requests.agg(F.min("requested_at"), F.max("requested_at")).first()
    step = (last - first) / 3
    times = [first, first + step, first + 2 * step, None]
    for part, (start, stop) in enumerate(zip(times, times[1:])):
        arriving = star.order_requests.where(F.col("requested_at") >= (first if part == 1 else start))
        if stop is not None:
            arriving = arriving.where(F.col("requested_at") < stop)
        arriving.select(*REQUESTS.names).write.mode("append").parquet(f"{base}/in")
        intake_stream(spark, f"{base}/in", tables, f"{base}/out", f"{base}/checkpoint{part // 2}").awaitTermination()
    return _with_orders(placed(spark, f"{base}/out", "items"), placed(spark, f"{base}/out", "orders"))


@query
def contract_audit(star):
    return quality.contract_audit(star.operational())


@query
def table_profile(star):
    return quality.table_profile(star.operational())


@query
def run_log_summary(star):
    return runlog.run_log_summary(star.run_logs).withColumn(
        "flagged_ids", F.concat_ws(",", F.transform("flagged_ids", lambda i: i.cast("string"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: present(function(StarTables(spark, folder)))

    return {name: bind(function) for name, function in _QUERIES.items()}
