"""Operator 12: reply trees to conversations, by self-joins; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark.llm.common import table
from driftspark.session import settle

# The template. A turn is HEAD, role, MIDDLE, text, END.
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
LEARNT = ["assistant"]


def escape(text: Column) -> Column:
    """``text`` (null: empty) in a form that holds neither ``###`` nor ``</turn>``, by a backslash inside each.

    Every backslash of the text is doubled first, so :func:`unescape` gives back any text. Each pattern is of
    fixed length: texts of any size are one pass.
    """
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, "#(?=##)", r"#\\"), "<(?=/turn>)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    """As :func:`escape`, and without ``": "``, so the first one of a turn ends its role."""
    return F.regexp_replace(escape(role), ":(?= )", r":\\")


def tree_nodes(messages: DataFrame) -> DataFrame:
    """One row for each (tree, id) of ``messages``: ``tree``, ``id``, ``parent``, ``role``, ``text``, ``score``.

    Of messages that repeat an id, the first one by parent, score (highest), role and text counts; rows without
    an id are a message each, kept as they are.
    """
    first = Window.partitionBy("tree", "id").orderBy(F.col("parent").asc_nulls_first(), F.col("score").desc_nulls_last(), "role", "text")
    named = messages.filter("id IS NOT NULL")
    once = named.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    columns = ["tree", "id", "parent", "role", "text", "score"]
    return once.select(*columns).unionByName(messages.filter("id IS NULL").select(*columns))


def root_paths(nodes: DataFrame, name: str = "paths") -> tuple[DataFrame, list[DataFrame]]:
    """``tree``, ``id``, ``depth`` (0 for a root) and ``score`` (sum from the root down) of every node that hangs
    on a root, and the tables of jumps: the k-th holds the 2^k-th ancestor ``up`` of the nodes that have one.

    Pointer doubling: each round joins the jumps that have not come to a root yet with all jumps, so the number
    of rounds grows with the logarithm of the longest path, a node takes part in as many as its own depth needs,
    and every round is a join on (tree, id), which may be split whatever the size of a tree. Rows hold ids and
    numbers alone. Nodes whose parents run in a circle hang on no root.
    """
    own = nodes.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = own.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    linked = own.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")) & (F.col("id") != F.col("parent")), "left")
    state = settle(linked.select("tree", "id", F.col("i").alias("up"), F.col("i").isNotNull().cast("long").alias("depth"), "score"), name)
    total, step = state.count(), 1
    at_root, open_ = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    jumps = []
    while step <= total and open_.count():  # longer jumps than there are nodes: only circles are left
        jumps.append(open_.select("tree", "id", "up"))
        above = at_root.unionByName(open_).select(
            F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("plus")
        )
        # ``score`` sums the nodes from the node itself up to, but without, ``up``; every ``up`` is a node.
        joined = open_.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")))
        state = settle(
            joined.select(
                "tree", "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("plus")).alias("score")
            ),
            name,
        )
        at_root, open_ = at_root.unionByName(state.filter("up IS NULL")), state.filter("up IS NOT NULL")
        step *= 2
    return at_root.select("tree", "id", "depth", "score"), jumps


def chosen_paths(nodes: DataFrame, best: int | None = 1, name: str = "paths") -> DataFrame:
    """``tree``, ``leaf``, ``rank``, ``path_score``, ``id`` and ``depth``: the nodes of the ``best`` branches of each
    tree (null: all), from root to leaf.

    A branch ends in a node without replies. Branches rank by the sum of the scores of their messages (null: 0),
    highest first, then by the id of the leaf; rank is ``row_number``, which Spark cuts off in each task.
    """
    at, jumps = root_paths(nodes, name)
    parents = nodes.filter("id != parent").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    replied = F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p"))
    leaves = at.join(parents, replied, "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    path = ranked.select("tree", F.col("id").alias("leaf"), "rank", F.col("score").alias("path_score"), "id", "depth")
    # Every node reached so far also gives its 2^k-th ancestor, from the longest jumps down to single steps.
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        further = path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select(
            "tree", "leaf", "rank", "path_score", F.col("up").alias("id"), (F.col("depth") - 2**k).alias("depth")
        )
        path = settle(path.unionByName(further), f"{name}_nodes")
    return path


def format_paths(messages: DataFrame, best: int | None = 1, learnt: list[str] = LEARNT, name: str = "chat") -> DataFrame:
    """The chosen branches of reply trees as conversations: ``tree``, ``leaf``, ``rank``, ``path_score``, ``n_turns``,
    ``formatted`` and ``loss``.

    ``messages`` has ``tree``, ``id``, ``parent``, ``role``, ``text`` and ``score``; other columns are not carried, so
    none can clash. A turn is ``### role: text</turn>`` and a line feed, with control strings escaped
    (:func:`escape`); null roles and texts are empty, a null tree is one like others. ``loss`` lists the spans to
    learn, in order: the texts of the roles ``learnt``, as code points (``start``, ``end``; end exclusive) and UTF-8
    bytes (``start_byte``, ``end_byte``) of ``formatted``. A parent that does not exist, or that is the message
    itself, is no parent; messages in a circle are in no path; one without an id is a branch of its own behind
    all others of its tree. An empty table gives an empty one.

    Offsets are running sums in path order, so a path of any length is one pass; the conversation itself is one
    text and so one row.
    """
    nodes = settle(tree_nodes(messages), f"{name}_messages")
    named, lone = nodes.filter("id IS NOT NULL"), nodes.filter("id IS NULL")
    path = chosen_paths(named, best, name)
    texts = named.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    turns = path.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select(
        "tree", "leaf", "rank", "path_score", "depth", "role", "text"
    )
    taken = path.groupBy(F.col("tree").alias("t")).agg(F.max("rank").alias("taken"))
    behind = F.row_number().over(Window.partitionBy("tree").orderBy("role", "text"))
    further = lone.withColumn("n", behind).join(taken, F.col("tree").eqNullSafe(F.col("t")), "left").select(
        "tree", F.lit(None).cast(path.schema["leaf"].dataType).alias("leaf"), (F.coalesce("taken", F.lit(0)) + F.col("n")).alias("rank"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("path_score"), F.lit(0).cast("long").alias("depth"), "role", "text",
    )
    turns = turns.unionByName(further if best is None else further.filter(F.col("rank") <= best))
    return _conversations(turns, learnt)


def _conversations(turns: DataFrame, learnt: list[str]) -> DataFrame:
    key = ["tree", "leaf", "rank", "path_score"]
    head = F.concat(F.lit(HEAD), _escape_role(F.col("role")), F.lit(MIDDLE))
    parts = turns.select(
        *key, "depth", head.alias("head"), escape(F.col("text")).alias("body"), F.coalesce(F.col("role").isin(learnt), F.lit(False)).alias("learn")
    )
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)

    def offsets(measure) -> tuple[Column, Column]:
        whole = measure(F.col("head")) + measure(F.col("body")) + len(END)
        start = F.coalesce(F.sum(whole).over(before), F.lit(0)) + measure(F.col("head"))
        return start.cast("long"), (start + measure(F.col("body"))).cast("long")

    start, end = offsets(F.char_length)
    start_byte, end_byte = offsets(F.octet_length)
    span = F.struct(start.alias("start"), end.alias("end"), start_byte.alias("start_byte"), end_byte.alias("end_byte"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("learn"), F.col("span")).alias("span"))
    listed = parts.withColumn("span", span).groupBy(*key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return listed.select(
        *key, F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.col("turns.piece")).alias("formatted"), F.array_compact(F.col("turns.span")).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, END, -1), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        at = F.locate(MIDDLE, piece)  # the first one: an escaped role holds none
        return F.struct(
            unescape(piece.substr(F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
            unescape(piece.substr(at + len(MIDDLE), F.char_length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped; cut out by bytes, which does not walk the text for each span."""

    def cut(data: Column) -> Column:
        return F.concat_ws("", F.transform(
            loss, lambda s: unescape(F.substring(data, s["start_byte"].cast("int") + 1, (s["end_byte"] - s["start_byte"]).cast("int")).cast("string"))
        ))

    return F.element_at(F.transform(F.array(formatted.cast("binary")), cut), 1)


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations given turn by turn, as reply trees without branches: every turn replies to the one before.

    Turns are in the order of ``order`` (null first), then role and text; rows that repeat a turn are turns of
    their own. Only the numbering needs the turns of a conversation together, as a stream of sorted rows.
    """
    by_turn = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    numbered = turns.select(F.col(tree).alias("tree"), F.row_number().over(by_turn).cast("long").alias("id"), F.col(role).alias("role"), F.col(text).alias("text"))
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


PLANTED = -7
# The fixed text of the extra conversation.
PLANTED_TEXT = r"\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the planted one, formatted and read back from the output."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"),
    )
    rows = format_paths(chains(given.unionByName(planted)))
    read = rows.select(
        F.col("tree").alias("conv_id"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP12_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, ': ', ''))) // 2
    + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)
    + (length(role) - length(replace(role, '</turn>', ''))) // 7 + 4 + 2 + 8 AS chars
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
