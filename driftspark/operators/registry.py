"""Registry of published contracts and the tool catalogue derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT, as_nodes, nodes_to_schema

# Matches listed if nothing else is asked for, and at most, by the interactive search.
DEFAULT_LIMIT, MAX_LIMIT = 10, 50
_APP = ["owner", "app"]
_BODY, _QUERY, _PATH = 3, 2, 1


def published_name(flag: Column, config: Column, project_root: Column) -> Column:
    """Name a contract is published under: explicit name, configured name, directory name."""
    return F.coalesce(flag, config, F.nullif(F.substring_index(project_root, "/", -1), F.lit("")), F.lit("my-app"))


def current(published: DataFrame) -> DataFrame:
    """G1: the newest version of every (owner, app); publishing again replaces."""
    newest = Window.partitionBy(*_APP).orderBy(F.col("version").desc())
    return published.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")


def search(
    published: DataFrame, query: str | None = None, stack: str | None = None, limit: int | None = DEFAULT_LIMIT,
    most: int | None = MAX_LIMIT,
) -> DataFrame:
    """Current contracts whose ``owner/app`` contains the query, whatever the case, by slug.

    At most ``limit`` rows, and never more than ``most``; both ``None`` gives all matches, in no order. A
    limited result has ``matches``, the number of all."""
    found = current(published).withColumn("slug", F.concat_ws("/", "owner", "app"))
    if query:
        found = found.where(F.contains(F.lower("slug"), F.lit(query.lower())))
    if stack:
        found = found.where(F.col("stack") == stack)
    bounds = [n for n in (limit, most) if n is not None]
    if not bounds:
        return found
    return found.orderBy("slug").limit(min(bounds)).withColumn("matches", F.lit(found.count()))


def lookup(published: DataFrame, owner: str, app: str) -> DataFrame:
    """The current contract of one app; the filter reaches the partition columns."""
    return current(published.where((F.col("owner") == owner) & (F.col("app") == app)))


def tool_name(method: Column, path: Column) -> Column:
    """``GET /api/users/[id]`` -> ``get_api_users_id``."""
    flat = F.regexp_replace(F.translate(path, "/[]", "_"), "^_", "")
    return F.concat(F.lower(method), F.lit("_"), F.regexp_replace(flat, "_+", "_"))


def tools(endpoints: DataFrame) -> DataFrame:
    """One tool per endpoint; ``name_count`` > 1 marks names that collide within an app."""
    named = endpoints.select(
        *ENDPOINT,
        tool_name(F.col("method"), F.col("path")).alias("tool"),
        F.coalesce("description", F.concat_ws(" ", "method", "path")).alias("description"),
    )
    # Counted by a join instead of a window: the tools of one large app stay spread over tasks.
    counts = named.groupBy(*_APP, "tool").agg(F.count(F.lit(1)).alias("name_count"))
    return named.join(counts, [*_APP, "tool"])


def tool_schemas(nodes: DataFrame) -> DataFrame:
    """G5 in full: per tool and input name the whole property schema of the winning source, as JSON Schema text.

    The nodes below each winning property become a schema of their own; large apps stay spread over tools.
    """
    winners = tool_inputs(nodes)
    below = nodes.where("size(node_path) >= 1 and location in ('path', 'query', 'body')").withColumn("top", F.element_at("node_path", 1))
    kept = below.join(winners.select(*ENDPOINT, "location", F.col("name").alias("top")), [*ENDPOINT, "location", "top"], "left_semi")
    rooted = kept.select(
        "owner", "app", "method", "path", F.to_json(F.struct("location", "top")).alias("location"),
        F.slice("node_path", F.lit(2), F.size("node_path")).alias("node_path"), F.substring("trail", 2, 1 << 30).alias("trail"),
        "type", F.when(F.size("node_path") > 1, F.col("required")).otherwise(F.lit(False)).alias("required"), "source", "sampled_type", "note", "example",
    )
    schemas = nodes_to_schema(as_nodes(rooted)).select(
        *ENDPOINT, F.get_json_object("location", "$.top").alias("name"), "schema"
    )
    return winners.join(schemas, [*ENDPOINT, "name"])


def tool_inputs(nodes: DataFrame) -> DataFrame:
    """Input properties per tool. A later source of the same name wins (path, query, body).

    Bodies of type ``unknown`` give nothing; a name is required if it is a path parameter or the
    body requires it.
    """
    opaque = nodes.where("location = 'body' and size(node_path) = 0 and type = 'unknown'").select(*ENDPOINT, "location")
    properties = nodes.where("size(node_path) = 1 and trail = 'p' and location in ('path', 'query', 'body')").join(
        opaque, [*ENDPOINT, "location"], "left_anti"
    )
    place = F.col("location")
    priority = F.when(place == "body", _BODY).when(place == "query", _QUERY).otherwise(_PATH)
    required = (place == "path") | ((place == "body") & F.col("required"))
    # Three candidates per name at most, so the winner is a plain aggregate.
    winner = F.max(F.struct(priority.alias("priority"), "type", "location"))
    return (
        properties.groupBy(*ENDPOINT, F.col("name"))
        .agg(winner.alias("w"), F.bool_or(required).alias("required"))
        .select(
            *ENDPOINT,
            tool_name(F.col("method"), F.col("path")).alias("tool"),
            "name",
            F.col("w.type").alias("type"),
            F.col("w.location").alias("location"),
            "required",
        )
    )
