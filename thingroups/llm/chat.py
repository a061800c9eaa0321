"""Chat formatting: paths of reply trees as one marked text each, with a loss mask.

Messages name their parent. Self-joins double the distance of each message's pointer in
every round, so a tree of depth d takes about log2(d) rounds; on the way the score and
the length of the path from the root add up. The leaves of a tree are ranked by the score
of their path, and the best ``keep`` of them are chosen. Their paths come from the stored
pointers, from the longest jump to the shortest, each message once.

A message is written as ``<|im_start|>role LF text <|im_end|> LF``. Inside texts each
``<|``, also with backslashes between its characters, gets one backslash more, so that no
control string is left; in roles ``%``, LF and ``|`` are written as in a URL. Both are undone
by ``parsed``. The loss mask has, for each turn, where it begins, and the range of
its text if that is to be learnt, in code points of the whole text.

A path is put together in parts of ``PART`` messages first, so that a long conversation
is spread over tasks until its text is joined. Message keys are unique, so that joins on
them meet one row each; popular parents are left to adaptive execution, which splits them.

Edge cases: NULL texts and roles are empty ones; rows of a conversation are ordered by
turn (NULL first), then role and text, and repeated rows are turns each; rows without
conversation id form one conversation; a message whose parent is not there is a root;
messages on a circle have no root and are on no path; of equal scores the smaller leaf
comes first, NULL scores count as 0; an empty table gives an empty table; further columns are
not looked at. A formatted text has to fit Spark's longest string, 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thingroups.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = ("assistant",)
PART = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def as_chains(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations without forks as messages: tree, message, parent, role, text, score.

    Rows are put in order by range partitions, whatever the size of a conversation; a
    message's number is its place in the whole order, its parent the row before it."""
    kept = rows.select(
        F.col(tree).alias("tree"),
        F.col(turn).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["tree", "turn", "role", "text"]
    ranged = stored(kept.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("part").orderBy(*order)
    # one row for each partition, so the windows over all of them are short
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("tree", "turn")).alias("last"))
    earlier = Window.orderBy("part")
    parts = parts.select(
        "part",
        (F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.lag("last").over(earlier).alias("last"),
    )
    numbered = (
        ranged.withColumns(
            {"at": F.row_number().over(inside), "above": F.lag(F.struct("tree", "turn")).over(inside)}
        )
        .join(F.broadcast(parts), "part")
        .withColumn("above", F.coalesce("above", "last"))
        .withColumn("message", (F.col("before") + F.col("at")).cast("long"))
    )
    follows = F.col("above").isNotNull() & F.col("above")["tree"].eqNullSafe(F.col("tree"))
    messages = numbered.select(
        "tree", "message", F.when(follows, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    return stored(messages, "messages")


def as_trees(
    rows: DataFrame, tree: str = "tree", message: str = "message", parent: str = "parent", score: str = "score"
) -> DataFrame:
    """Messages that name their parent, in the columns of ``as_chains``: one row for each
    key (of several the least), roots without parent. ``message`` must be a long."""
    kept = rows.where(F.col(message).isNotNull()).select(
        F.col(tree).alias("tree"),
        F.col(message).alias("message"),
        F.col(parent).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
    )
    line = F.struct("tree", "parent", "role", "text", "score")
    one = kept.groupBy("message").agg(F.min(line).alias("line")).select("message", "line.*")
    known = one.select(F.col("message").alias("parent"), F.lit(True).alias("known"))
    found = one.join(known, "parent", "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    return stored(found.select("tree", "message", "parent", "role", "text", "score"), "messages")


def _doubled(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """message, depth and total of each message that has a root, and the stored pointers
    (message, up) over 1, 2, 4, ... messages."""
    first = messages.select("message", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    hops = stored(first, "hops")
    rooted, open_, levels = hops.where("up IS NULL"), hops.where("up IS NOT NULL"), []
    most = hops.count().bit_length()  # what is open beyond that is on a circle
    while len(levels) <= most and not open_.isEmpty():
        levels.append(open_.select("message", "up"))
        there = rooted.unionByName(open_).select(
            F.col("message").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("added")
        )
        joined = open_.join(there, "up").select(
            "message",
            F.col("next").alias("up"),
            (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("total") + F.col("added")).alias("total"),
        )
        hops = stored(joined, "hops")
        rooted, open_ = rooted.unionByName(hops.where("up IS NULL")), hops.where("up IS NOT NULL")
    return rooted.drop("up"), levels


def paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """path, path_score, rank, message, at: the messages of the ``keep`` best root-to-leaf paths of
    each tree (None: all). A path is named by its leaf; ``at`` counts from 0 at the root."""
    rooted, levels = _doubled(messages)
    parents = messages.select(F.col("parent").alias("message")).where("message IS NOT NULL")
    leaves = messages.select("tree", "message").join(parents, "message", "left_anti").join(rooted, "message")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "message")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    chosen = ranked if keep is None else ranked.where(F.col("rank") <= keep)
    found = stored(chosen.select(F.col("message").alias("path"), F.col("total").alias("path_score"), "rank", "message"), "paths")
    for level in reversed(levels):
        above = found.join(level, "message").select("path", "path_score", "rank", F.col("up").alias("message"))
        found = found.unionByName(stored(above, "paths"))
    return found.join(rooted.select("message", (F.col("depth") - 1).alias("at")), "message")


def format_paths(messages: DataFrame, chosen: DataFrame, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """tree, path, rank, path_score, formatted and turns of each path: ``turns`` has for each one
    where it begins, and from where to where (exclusive) its text is under the loss mask, or NULLs."""
    opening = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    block = (
        messages.join(chosen, "message")
        .withColumns({"opening": opening, "body": body, "part": F.expr(f"at div {PART}")})
        .withColumn("block", F.concat("opening", "body", F.lit(END)))
        .withColumns({"n": F.char_length("block").cast("long"), "lead": F.char_length("opening").cast("long")})
    )
    inside = Window.partitionBy("path", "part").orderBy("at")
    start = F.sum("n").over(inside) - F.col("n")
    mark = lambda x: F.when(F.col("role").isin(*learnt), x)
    turn = F.struct(
        F.col("start"),
        mark(F.col("start") + F.col("lead")).alias("from"),
        mark(F.col("start") + F.col("n") - len(END)).alias("to"),
    )
    lines = F.sort_array(F.collect_list(F.struct("at", "block", "turn")))
    parts = (
        block.withColumn("start", start)
        .select("tree", "path", "rank", "path_score", "part", "at", "block", "n", turn.alias("turn"))
        .groupBy("path", "part")
        .agg(
            *[F.first(c).alias(c) for c in ("tree", "rank", "path_score")],
            F.sum("n").alias("n"),
            lines.alias("lines"),
        )
        .select(
            "tree", "path", "rank", "path_score", "part", "n",
            F.concat_ws("", F.transform("lines", lambda x: x["block"])).alias("text"),
            F.transform("lines", lambda x: x["turn"]).alias("turns"),
        )
        .withColumn("offset", F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n"))
    )
    moved = lambda t, by: F.struct(
        (t["start"] + by).alias("start"), (t["from"] + by).alias("from"), (t["to"] + by).alias("to")
    )
    whole = parts.groupBy("path").agg(
        *[F.first(c).alias(c) for c in ("tree", "rank", "path_score")],
        F.sort_array(F.collect_list(F.struct("part", "text", "offset", "turns"))).alias("parts"),
    )
    return whole.select(
        "tree", "path", "rank", "path_score",
        F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("formatted"),
        F.flatten(F.transform("parts", lambda p: F.transform(p["turns"], lambda t: moved(t, p["offset"])))).alias("turns"),
    )


def blocks(formatted: Column) -> Column:
    """The turns of a formatted text, each without its end mark."""
    return F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text: what was put in."""

    def one(b: Column) -> Column:
        line = F.locate("\n", b)
        role = b.substr(F.lit(len(START) + 1), line - (len(START) + 1))
        return F.struct(unescaped_role(role).alias("role"), unescaped(b.substr(line + 1, F.length(b))).alias("text"))

    return F.transform(blocks(formatted), one)


def masked(formatted: Column, turns: Column) -> Column:
    """The texts under the loss mask, in order, as they were put in."""

    def one(b: Column, t: Column) -> Column:
        inside = b.substr((t["from"] - t["start"] + 1).cast("int"), (t["to"] - t["from"]).cast("int"))
        return F.when(t["from"].isNotNull(), unescaped(inside))

    return F.filter(F.zip_with(blocks(formatted), turns, one), lambda x: x.isNotNull())


def format_conversations(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Every conversation as one formatted text with its mask."""
    messages = as_chains(rows, tree, turn)
    return format_paths(messages, paths(messages))


def report(rows: DataFrame) -> DataFrame:
    """Format all conversations, write them, and digest what is read back."""
    written = stored(format_conversations(rows), "conversations")
    said = F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.concat_ws("", masked(F.col("formatted"), F.col("turns")))
    return written.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        learnt.alias("learnt"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
