"""Webhook deliveries as a stream: signature check, routing on the payload, the actions that start an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pull-request actions that start an analysis.
ACTIONS = ("opened", "reopened", "synchronize", "ready_for_review")
PAYLOAD = "struct<action:string,number:long,repository:struct<full_name:string>,pull_request:struct<base:struct<sha:string>,head:struct<sha:string>>>"


def hmac_sha256(key: str, body: Column) -> Column:
    """Hex HMAC-SHA-256 of a binary column, from the built-in digest: H(key ^ opad | H(key ^ ipad | body))."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in raw))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))), 256)


def verified(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries (delivery_id, body, signature) whose signature is sha256=<HMAC of the body>."""
    return deliveries.filter(F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(secret, F.col("body"))))


def analysis_requests(deliveries: DataFrame) -> DataFrame:
    """delivery_id, repository, number, base_sha, head_sha of pull-request events that start an analysis."""
    parsed = deliveries.select("delivery_id", F.from_json(F.col("body"), PAYLOAD).alias("p")).filter(F.col("p.pull_request").isNotNull() & F.col("p.action").isin(*ACTIONS))
    return parsed.select("delivery_id", F.col("p.repository.full_name").alias("repository"), F.col("p.number").alias("number"), F.col("p.pull_request.base.sha").alias("base_sha"), F.col("p.pull_request.head.sha").alias("head_sha"))


def deduplicated(deliveries: DataFrame, time_col: str, watermark: str = "1 day") -> DataFrame:
    """Each delivery once within the watermark."""
    return deliveries.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["delivery_id"])


def allowed_actions(events: DataFrame, actions: tuple[str, ...], time_col: str = "ts", window: str = "1 day", watermark: str = "7 days") -> DataFrame:
    """Counts of allowed actions (event_type) in tumbling windows of event time."""
    own = events.filter(F.col("event_type").isin(*actions)).withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", watermark)
    return own.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
