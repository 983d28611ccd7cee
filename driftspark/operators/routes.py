"""Route discovery over a source corpus.

Input: ``source_files (repo, rel_path, content)``, one row per file. Everything but the stack label
is a narrow projection of the file's own row, and paths are filtered before any content is searched.
Signals inside handlers (R9-R12) are read from lexed code (``functions/lexer.py``): comments and strings are
not code, and a handler, a parameter list and the arguments of a call end where their brackets do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import patterns as P
from driftspark.functions.lexer import after_close, lexed, second_argument, statement, text_of
from driftspark.model import METHODS, STACKS

# Notes on endpoints whose handler cannot be read.
NO_HANDLER = "Handler could not be parsed"
WRAPPED = "Handler is a wrapped export (e.g. withAuth(fn)) — export a plain function for full inference"


def detect_stack(files: DataFrame) -> DataFrame:
    """Router and stack label per repository; partial aggregation leaves one row per repo and task."""
    path = F.col("rel_path")
    flags = files.groupBy("repo").agg(
        F.bool_or(path.startswith("app/api/")).alias("app"), F.bool_or(path.startswith("pages/api/")).alias("pages")
    )
    app, pages = F.col("app"), F.col("pages")
    router = F.when(app & pages, "hybrid").when(app, "app").when(pages, "pages").otherwise("none")
    label = F.when(F.col("router") == "hybrid", STACKS["hybrid"]).when(F.col("router") == "pages", STACKS["pages"])
    return flags.select("repo", router.alias("router")).withColumn("stack", label.otherwise(STACKS["app"]))


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def app_url_path(rel_path: Column) -> Column:
    """R2: ``app/api/users/[id]/route.ts`` -> ``/api/users/[id]``."""
    stripped = F.regexp_replace(rel_path, "^app", "")
    return _rooted(F.regexp_replace(stripped, r"/route\.(ts|js)$", ""))


def pages_url_path(rel_path: Column) -> Column:
    """``pages/api/users/index.ts`` -> ``/api/users``."""
    stripped = F.regexp_replace(rel_path, "^pages", "")
    return _rooted(F.regexp_replace(F.regexp_replace(stripped, r"\.(ts|js)$", ""), "/index$", ""))


def exported_methods(content: Column) -> Column:
    """Methods a file exports, in fixed order."""
    return F.array_compact(F.array(*[F.when(content.rlike(P.exported_method(m)), F.lit(m)) for m in METHODS]))


def has_default_export(content: Column) -> Column:
    """R5."""
    return content.rlike("|".join(P.DEFAULT_EXPORT))


def branch_methods(content: Column) -> Column:
    """Known methods a handler compares with or switches on; empty when there are none."""
    compared = F.regexp_extract_all(content, F.lit(P.METHOD_COMPARED), F.lit(1))
    cases = F.regexp_extract_all(content, F.lit(P.METHOD_CASE), F.lit(1))
    return F.array_intersect(F.array_union(compared, cases), F.array(*[F.lit(m) for m in METHODS]))


def app_routes(files: DataFrame) -> DataFrame:
    """One row per App Router file and exported method."""
    found = files.where(F.col("rel_path").rlike(P.APP_ROUTE_FILE)).select(
        "*", app_url_path(F.col("rel_path")).alias("path"), F.posexplode(exported_methods(F.col("content"))).alias("position", "method")
    )
    return found.withColumn("router_type", F.lit("app")).withColumn("branching", F.lit(False))


def pages_routes(files: DataFrame) -> DataFrame:
    """One row per Pages Router file and method; a handler without branches stands for GET."""
    path = F.col("rel_path")
    kept = files.where(
        path.rlike(P.PAGES_ROUTE_FILE)
        & ~path.contains("_middleware")
        & ~path.contains("_app")
        & has_default_export(F.col("content"))
    )
    kept = kept.withColumn("found", branch_methods(F.col("content")))
    branching = F.size("found") > 0
    methods = F.when(branching, F.col("found")).otherwise(F.array(F.lit("GET")))
    return (
        kept.select(
            "*", pages_url_path(path).alias("path"), branching.alias("branching"),
            F.posexplode(methods).alias("position", "method"),
        )
        .drop("found")
        .withColumn("router_type", F.lit("pages"))
    )


def path_parameter_names(path: Column) -> Column:
    """Parameter names in order, without the ``...`` of catch-all segments."""
    return F.transform(
        F.regexp_extract_all(path, F.lit(P.PATH_PARAMETER), F.lit(1)), lambda name: F.regexp_replace(name, r"^\.\.\.", "")
    )


def path_parameters(routes: DataFrame) -> DataFrame:
    """One row per parameter of ``path``; catch-all parameters are arrays of strings."""
    raw = F.regexp_extract_all(F.col("path"), F.lit(P.PATH_PARAMETER), F.lit(1))
    exploded = routes.select("*", F.posexplode(raw).alias("ordinal", "raw"))
    catch_all = F.col("raw").startswith("...")
    return exploded.select(
        *[c for c in routes.columns],
        "ordinal",
        F.regexp_replace("raw", r"^\.\.\.", "").alias("name"),
        F.when(catch_all, "array").otherwise("string").alias("type"),
        F.when(catch_all, "string").alias("items_type"),
        F.lit(True).alias("required"),
    )


def resolve_paths(routes: DataFrame, params: Column) -> DataFrame:
    """Fill ``[name]`` from a MAP column; names the map lacks stay and are listed in ``missing``.

    A path is cut into literal pieces and names, so a value is never searched for further names.
    """
    names = F.regexp_extract_all(F.col("path"), F.lit(P.PATH_PARAMETER), F.lit(1))
    pieces = F.split(F.col("path"), P.PATH_PARAMETER, -1)
    filled = F.transform(
        pieces,
        lambda piece, i: F.concat(
            piece,
            F.when(i >= F.size(names), F.lit("")).otherwise(
                F.coalesce(
                    F.try_element_at(params, F.get(names, i)),
                    F.concat(F.lit("["), F.get(names, i), F.lit("]")),
                )
            ),
        ),
    )
    missing = F.filter(names, lambda name: ~F.map_contains_key(params, name))
    return routes.select("*", F.array_join(filled, "").alias("resolved"), missing.alias("missing"))


def _by_method(column: Callable[[str], Column]) -> Column:
    """``column(m)`` for the row's own method m; patterns stay literals and are compiled once."""
    out = F.lit(None)
    for m in METHODS:
        out = F.when(F.col("method") == m, column(m)).otherwise(out)
    return out


def first_sentence(comment: Column) -> Column:
    """Comment text up to the first period followed by white space, ending with a period."""
    lines = F.regexp_replace(comment, r"(?m)^[ \t]*\*[ \t]?", "")
    description = F.regexp_extract(lines, r"(?s)\A(.*?)(?:^|\n)[ \t]*@\w+", 1)
    text = F.trim(F.regexp_replace(F.when(lines.rlike(r"(?m)^[ \t]*@\w+"), description).otherwise(lines), r"^\s+|\s+$", ""))
    sentence = F.regexp_replace(F.element_at(F.split(text, r"\.\s", 2), 1), r"^\s+|\s+$", "")
    return F.when(text != "", F.when(sentence.endswith("."), sentence).otherwise(F.concat(sentence, F.lit("."))))


def _comment(code: Column, start: str) -> Column:
    found = F.regexp_extract(code, P.comment_before(start), 1)
    return F.when(found != "", text_of(found))


def _ints(codes: Column) -> Column:
    """Distinct codes, 200 where there is no response call; a number that is no integer gives no code."""
    fallback = F.array(F.lit(200))
    return F.when(F.size(codes) > 0, F.array_distinct(F.array_compact(codes))).otherwise(fallback)


def app_status_codes(handler: Column) -> Column:
    """R10, App Router: ``{status: N}`` as second argument of each response call in lexed code, 200 without one.

    A call is read up to the next response call, so one that holds another as an argument counts as 200.
    """
    pieces = F.split(handler, P.APP_RESPONSE)
    calls = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda call: ~call.rlike(r"\A\s*\)"))

    def code(call: Column) -> Column:
        found = F.regexp_extract(second_argument(call), P.APP_STATUS, 1)
        return F.when(found == "", F.lit(200)).otherwise(found.try_cast("int"))

    return _ints(F.transform(calls, code))


def pages_status_codes(code: Column) -> Column:
    """R10, Pages Router: ``res.status(N).json(`` and ``res.json(`` in lexed code."""
    calls = F.regexp_extract_all(code, F.lit(P.PAGES_RESPONSE), F.lit(1))
    return _ints(
        F.transform(calls, lambda arg: F.when(F.trim(arg).rlike(r"^\d+$"), F.trim(arg)).otherwise("200").try_cast("int"))
    )


def app_query_names(handler: Column) -> Column:
    """R9, App Router: names read with ``searchParams.get`` in lexed code."""
    return F.array_distinct(F.transform(F.regexp_extract_all(handler, F.lit(P.SEARCH_PARAMETER), F.lit(1)), text_of))


def pages_query_names(code: Column, path: Column) -> Column:
    """R9, Pages Router: ``req.query.name`` and destructured names in lexed code, without path parameters."""
    direct = F.regexp_extract_all(code, F.lit(P.QUERY_PROPERTY), F.lit(1))
    lists = F.regexp_extract_all(code, F.lit(P.QUERY_DESTRUCTURED), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda names: F.split(names, ",")))
    local = F.transform(
        parts,
        lambda part: F.regexp_replace(
            F.substring_index(F.regexp_replace(part, r"(?s)=.*", ""), ":", -1), r"\s|\.\.\.", ""
        ),
    )
    names = F.filter(F.concat(direct, local), lambda name: name != "")
    return F.array_except(F.array_distinct(names), path_parameter_names(path))


def route_signals(routes: DataFrame) -> DataFrame:
    """R9-R12 for the rows of :func:`app_routes` and :func:`pages_routes`.

    An App handler is its export statement; a Pages file shares all signals among its methods. An export that
    stands in a comment or string only has no handler. A null ``content`` has no routes and so no row here.
    """
    is_app = F.col("router_type") == "app"
    code, begun = F.col("__code"), F.col("__begun")
    staged = routes.withColumn("__code", lexed(F.col("content")))
    staged = staged.withColumn("__begun", F.when(is_app, _by_method(lambda m: F.regexp_extract(code, P.from_export(m), 0))))
    behind = after_close(F.regexp_replace(begun, P.EXPORTED_LIST, ""))
    status = F.when(
        is_app,
        F.when(begun.rlike(P.EXPORTED_FUNCTION) | begun.rlike(P.EXPORTED_EXPRESSION), "found")
        .when(F.when(begun.rlike(P.EXPORTED_LIST), behind.rlike(P.ARROW)).otherwise(False), "found")
        .when(begun.rlike(P.EXPORTED_CALL), "wrapper")
        .otherwise("not-found"),
    ).otherwise("found")
    staged = staged.withColumn("inferability", status)
    staged = staged.withColumn("__handler", F.when(is_app & (F.col("inferability") == "found"), statement(begun)))
    found, handler = F.col("inferability") == "found", F.col("__handler")
    comment = F.when(
        is_app, _by_method(lambda m: _comment(code, P.exported_method(m)))
    ).otherwise(_comment(code, r"export\s+default"))
    staged = staged.withColumn("__comment", F.when(found, comment))
    return staged.select(
        *[c for c in routes.columns],
        "inferability",
        F.when(found, F.when(is_app, app_query_names(handler)).otherwise(pages_query_names(code, F.col("path"))))
        .otherwise(F.array().cast("array<string>")).alias("query_names"),
        F.when(found, F.when(is_app, app_status_codes(handler)).otherwise(pages_status_codes(code)))
        .otherwise(F.array(F.lit(200))).alias("status_codes"),
        F.when(found, first_sentence(F.col("__comment"))).alias("description"),
        F.when(found, F.lit(None)).when(F.col("inferability") == "wrapper", WRAPPED).otherwise(NO_HANDLER).alias("note"),
    )


def route_inventory(files: DataFrame) -> DataFrame:
    """Every endpoint of the corpus, one row per (file, method)."""
    routes = app_routes(files).unionByName(pages_routes(files), allowMissingColumns=True)
    return route_signals(routes).drop("content")
