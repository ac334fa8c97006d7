"""The monitored tables, derived from the driver's tables. ``oracles.VIEWS`` has the same in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _address(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 40, "0"))


def _hash(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(number.cast("string"), 256))


def _ts(when: Column) -> Column:
    return when.cast("timestamp")


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        _address(key + 171).alias("address"),
        F.lit("ethereum").alias("chain"),
        (key % 4 != 0).alias("is_active"),
        (key * 100).alias("last_seen_block"),
        _ts(F.date_sub(F.lit("2024-01-01").cast("date"), key.cast("int"))).alias("created_at"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("id"),
        (cust % 10).alias("protocol_id"),
        _hash(key).alias("tx_hash"),
        key.alias("block_number"),
        _address(cust + 100).alias("from_address"),
        F.when(key % 97 != 0, _address(cust % 10 + 171)).alias("to_address"),
        (F.col("o_totalprice") / 1000).alias("value_eth"),
        (F.lit(21000) + (key % 50) * 10000).alias("gas_used"),
        F.concat(F.lit("0x"), F.sha2("o_orderpriority", 256)).alias("input_data"),
        F.when(key % 11 != 0, (key * 37) % 101).cast("int").alias("risk_score"),
        F.col("o_orderpriority").alias("risk_summary"),
        F.lit(None).cast("timestamp").alias("scored_at"),
        _ts(F.col("o_orderdate")).alias("fetched_at"),
    )


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that holds only part of the transactions: those of finished orders."""
    finished = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return transactions(spark, sf_dir).join(finished, "id", "left_semi")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        transactions(spark, sf_dir)
        .filter("risk_score >= 70")
        .select(
            "id",
            F.col("id").alias("transaction_id"),
            "risk_score",
            "risk_summary",
            (F.col("id") % 3 != 0).alias("telegram_sent"),
            F.col("fetched_at").alias("created_at"),
        )
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind != "view", F.col("user_id")).alias("api_key_id"),
        F.concat(F.lit("/api/"), kind).alias("endpoint"),
        F.lit("GET").alias("method"),
        F.when(kind == "error", 429).otherwise(200).alias("status_code"),
        F.floor("value").cast("int").alias("response_ms"),
        _ts(F.col("ts")).alias("created_at"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they come in, over the entry path of the hosted API or not, to the API or not."""
    kind = F.col("event_type")
    path = (
        F.when(kind == "view", F.concat(F.lit("/api/index.py/"), kind))
        .when(kind == "click", F.concat(F.lit("/api/index/"), kind))
        .when(kind == "signup", F.lit("/api/index"))
        .when(kind == "error", F.concat(F.lit("/assets/"), kind))
        .otherwise(F.concat(F.lit("/api/"), kind))
    )
    log = request_log(spark, sf_dir)
    raw = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), path.alias("endpoint"))
    return log.drop("endpoint").join(raw, "id").select(log.columns)


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key_hash = F.sha2(F.concat(F.lit("key-"), F.col("user_id").cast("string")), 256)
    return (
        load(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), _ts(F.max("ts")).alias("last"), _ts(F.min("ts")).alias("first"))
        .select(
            F.col("user_id").alias("id"),
            key_hash.alias("key_hash"),
            F.substring(key_hash, 1, 9).alias("key_prefix"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"),
            F.lit(None).cast("bigint").alias("waitlist_id"),
            (F.col("user_id") % 5 != 0).alias("is_active"),
            F.col("n").alias("requests_today"),
            F.col("n").alias("requests_total"),
            F.col("last").alias("last_used_at"),
            F.col("first").alias("created_at"),
        )
    )


def waitlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, key = F.col("c_nationkey") % 3, F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.concat(F.col("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
        F.lit(None).cast("string").alias("name"),
        F.col("c_mktsegment").alias("project"),
        F.lit(None).cast("string").alias("twitter"),
        F.when(nation == 0, "pending").when(nation == 1, "approved").otherwise("rejected").alias("status"),
        F.lit(None).cast("bigint").alias("api_key_id"),
        _ts(F.date_sub(F.lit("2024-01-01").cast("date"), (key % 365).cast("int"))).alias("applied_at"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider answers of all kinds: usable, fenced, not JSON, out of range, of the wrong type."""
    good = F.replace(F.col("props"), F.lit('"k"'), F.lit('"risk_score"'))
    kind = F.col("event_id") % 7
    content = (
        F.when(kind == 0, F.lit("not json"))
        .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, F.lit('{"risk_score": 150}'))
        .when(kind == 3, F.lit('{"risk_score": "87"}'))
        .when(kind == 4, F.lit('{"risk_score": 87.5}'))
        .otherwise(good)
    )
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), _hash(F.col("event_id")).alias("tx_hash"), content.alias("content")
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain transactions with hex fields; ``pos`` is the order key, ``gasUsed`` that of the receipt."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sender = F.lpad(F.lower(F.hex(cust + 100)), 40, "0")
    target = F.lpad(F.lower(F.hex(cust % 20 + 171)), 40, "0")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    prefix = F.lit("0x")
    return load(spark, sf_dir, "orders").select(
        key.alias("pos"),
        _hash(key).alias("hash"),
        F.concat(prefix, F.lower(F.hex(F.floor(key / 10).cast("bigint")))).alias("blockNumber"),
        F.concat(prefix, F.when(key % 2 == 0, F.upper(sender)).otherwise(sender)).alias("from"),
        F.when(
            key % 97 != 0, F.concat(prefix, F.when(key % 2 == 1, F.upper(target)).otherwise(target))
        ).alias("to"),
        F.concat(prefix, F.lower(F.hex(cents)), F.lit("0" * 12)).alias("value"),
        F.concat(prefix, F.lower(F.hex(F.lit(21000) + key % 1000))).alias("gas"),
        F.concat(prefix, F.repeat(F.sha2("o_orderpriority", 256), F.lit(10))).alias("input"),
        F.when(key % 5 != 0, F.lit("0x5208")).alias("gasUsed"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        raw_transactions(spark, sf_dir)
        .filter(F.col("gasUsed").isNotNull())
        .select(F.col("hash").alias("transactionHash"), "gasUsed", "blockNumber")
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as landed: ten transactions each."""
    fields = ("hash", "blockNumber", "from", "to", "value", "gas", "input")
    return (
        raw_transactions(spark, sf_dir)
        .groupBy(F.col("blockNumber").alias("number"))
        .agg(F.collect_list(F.struct(*fields)).alias("transactions"))
    )


def registration_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses known, new, repeated in another case, and malformed."""
    key = F.col("c_custkey")
    number = F.lpad(F.hex(key - key % 3 + 171), 40, "0")
    good = F.concat(F.lit("0x"), F.when(key % 2 == 0, F.upper(number)).otherwise(F.lower(number)))
    return load(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(key % 13 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("0x123")).otherwise(good).alias("address"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by e-mails on the list in another case, by new ones, repeated ones and malformed ones."""
    key = F.col("c_custkey")
    old = F.upper(F.concat(F.col("c_name"), F.lit("@"), F.col("c_mktsegment"), F.lit(".example")))
    new = F.concat(F.lit("Applicant"), (key % 400).cast("string"), F.lit("@new.example"))
    return load(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(key % 3 == 0, old).when(key % 31 == 0, F.lit("no address")).otherwise(new).alias("email"),
        F.col("c_name").alias("name"),
        F.when(key % 29 == 0, F.repeat(F.lit("x"), F.lit(161))).otherwise(F.col("c_mktsegment")).alias("project"),
        F.lit("watch my pool").alias("goal"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals (signup) and rejections (error) of applications, several per application."""
    return (
        load(spark, sf_dir, "events")
        .filter("event_type IN ('signup', 'error')")
        .select(
            F.col("event_id").alias("decision_id"),
            (F.col("event_id") % 2000).alias("waitlist_id"),
            F.when(F.col("event_type") == "signup", "approve").otherwise("reject").alias("action"),
            F.when(F.col("event_type") == "signup", F.col("user_id")).alias("api_key_id"),
            _ts(F.col("ts")).alias("decided_at"),
        )
    )


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("protocol_id"))


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("protocol_id"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("alert_id"))


def revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key_id"))


def presented_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys known, unknown, and with a blank behind."""
    text = F.concat(F.lit("key-"), (F.col("user_id") * 2).cast("string"))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "click", F.concat(text, F.lit(" "))).otherwise(text).alias("api_key"),
    )


def new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("key-"), (F.col("s_suppkey") * 3).cast("string")).alias("api_key"),
        F.col("s_name").alias("name"),
    )


def flagged_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").filter("s_acctbal < 1000").select(
        _address(F.col("s_suppkey") + 100).alias("address")
    )
