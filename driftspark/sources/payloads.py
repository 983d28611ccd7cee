"""Payload logs: which captured responses may teach a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.functions.patterns import PATH_PARAMETER
from driftspark.model import ENDPOINT

READ_METHODS = ["GET", "DELETE"]


def classify(
    payloads: DataFrame,
    include_writes: bool = False,
    success_only: bool = False,
    params: str | None = None,
    parse: bool = True,
) -> DataFrame:
    """Status (sampled, skipped, failed) and reason of every payload, decided in its own row.

    ``params`` names a MAP column with the path parameters known for the call; without it, path
    templates count as filled, since a logged payload proves that the call was made. ``parse=False``
    leaves unreadable bodies to whoever parses them next.
    """
    method = F.col("method")
    content_type = F.coalesce("content_type", F.lit(""))
    write = ~method.isin(*READ_METHODS)
    not_json = ~F.contains(content_type, F.lit("application/json"))
    unreadable = F.try_parse_json("body").isNull()

    status, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")

    def rule(condition, outcome, why):
        nonlocal status, reason
        status, reason = status.when(condition, outcome), reason.when(condition, why)

    if not include_writes:
        rule(write, "skipped", F.concat(method, F.lit(" skipped (write methods are not sampled)")))
    if params:
        names = F.regexp_extract_all(F.col("path"), F.lit(PATH_PARAMETER), F.lit(1))
        missing = F.filter(names, lambda n: ~F.map_contains_key(F.col(params), n))
        listed = F.array_join(F.transform(missing, lambda n: F.concat(F.lit("["), n, F.lit("]"))), ", ")
        rule(F.size(missing) > 0, "skipped", F.concat(F.lit("Path param(s) not provided: "), listed))
    rule(
        not_json, "failed",
        F.concat(F.lit("Not JSON (content-type: "), F.when(content_type == "", "none").otherwise(content_type), F.lit(")")),
    )
    if success_only:
        rule(~F.col("status").between(200, 299), "skipped", F.concat(F.lit("Status "), F.col("status").cast("string")))
    if parse:
        rule(unreadable, "failed", F.lit("Request failed: body is not valid JSON"))
    return payloads.withColumn("outcome", status.otherwise("sampled")).withColumn("reason", reason)


def sampled(payloads: DataFrame, **options) -> DataFrame:
    """The payloads that may teach a schema. Schema inference skips unreadable bodies as it parses them."""
    return classify(payloads, parse=False, **options).where("outcome = 'sampled'").drop("outcome", "reason")


def sampling_targets(endpoints: DataFrame, nodes: DataFrame, sampled_only: bool = False) -> DataFrame:
    """Baseline endpoints whose payloads count; all, or those whose response was sampled before."""
    targets = endpoints.select(*ENDPOINT).distinct()
    if not sampled_only:
        return targets
    marked = nodes.where("location = 'response' and size(node_path) = 0 and source = 'sampled'")
    return targets.join(marked.select(*ENDPOINT), ENDPOINT, "left_semi")


def targeted(payloads: DataFrame, targets: DataFrame) -> DataFrame:
    return payloads.join(targets, ENDPOINT, "left_semi")


def sample_status(endpoints: DataFrame, payloads: DataFrame, summary: DataFrame, **options) -> DataFrame:
    """What sampling gave, one row per endpoint: outcome, reason, status code, new and removed fields.

    An endpoint counts as sampled if any payload of it was, else as failed or skipped; code and reason are those
    of the newest payload of that outcome. ``summary`` is the field summary of the merge. Endpoints without a
    payload are skipped.
    """
    rank = F.when(F.col("outcome") == "sampled", 2).when(F.col("outcome") == "failed", 1).otherwise(0)
    newest = F.max(F.struct(rank.alias("rank"), "ts", "status", "outcome", "reason")).alias("last")
    tried = classify(payloads, **options).groupBy(*ENDPOINT).agg(newest).select(
        *ENDPOINT, "last.outcome", "last.reason", F.col("last.status").alias("status")
    )
    named = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("name"))))
    fields = summary.groupBy(*ENDPOINT).agg(named("new").alias("new_fields"), named("removed").alias("removed_fields"))
    none = F.array().cast("array<string>")
    sampled_ = F.col("outcome") == "sampled"
    return endpoints.select(*ENDPOINT).distinct().join(tried, ENDPOINT, "left").join(fields, ENDPOINT, "left").select(
        *ENDPOINT,
        F.coalesce("outcome", F.lit("skipped")).alias("outcome"),
        F.when(F.col("outcome").isNull(), "No payload").otherwise(F.col("reason")).alias("reason"),
        F.when(sampled_, F.col("status")).alias("status"),
        F.when(sampled_, F.coalesce("new_fields", none)).otherwise(none).alias("new_fields"),
        F.when(sampled_, F.coalesce("removed_fields", none)).otherwise(none).alias("removed_fields"),
    )
