"""Chat formatting into budgeted windows, by DataFrame functions alone.

A turn is written ``### role``, a line break, its text and ``</turn>`` with a line break. In texts and
roles a backslash, ``###`` and ``</turn>`` (in roles a line break too) become a backslash and a letter,
which no other text can give, so what was written can be read back exactly.

A conversation longer than the token budget is cut between turns: prefix sums of the turns' tokens tell
where the next turn would overflow a window. Every window keeps the conversation's system turn and
repeats a limited number of tokens of the turns before it. Only new assistant texts are under the loss
mask, so a repeated one is never learned twice.

Turns are dealt by (conversation, turn / ``BLOCK``): a conversation of any length spreads over tasks,
and no array holds more than ``BLOCK`` turns. A window and its repeated turns stay within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a block.
BLOCK = 1024
TURN_HEAD, TURN_TAIL = "### ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("\n", "\\n"))


def escaped(text: Column, line_breaks: bool = False) -> Column:
    for plain, code in ESCAPES if line_breaks else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, line_breaks: bool = False) -> Column:
    """The backslash comes last: till then every backslash begins a code."""
    for plain, code in reversed(ESCAPES if line_breaks else ESCAPES[:-1]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def word_count(text: Column) -> Column:
    """Runs without ASCII white space, the default measure of a turn's tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))).cast("long")


def _written(turn: Column) -> Column:
    head = F.concat(F.lit(TURN_HEAD), escaped(turn["role"], True), F.lit("\n"))
    return F.concat(head, escaped(turn["text"]), F.lit(TURN_TAIL))


def _before(turns: Column) -> Column:
    """Prefix sums: tokens of all turns before each, and of all."""
    return F.aggregate(
        turns,
        F.array(F.lit(0).cast("long")),
        lambda sums, turn: F.concat(sums, F.array(F.element_at(sums, -1) + turn["tokens"])),
    )


def _starts(room: Column) -> Column:
    """Places (from 0) where windows begin: a turn that would not fit after the window's first starts the next."""
    return F.aggregate(
        F.when(F.size("turns") > 1, F.sequence(F.lit(1), F.size("turns") - 1)).otherwise(F.array().cast("array<int>")),
        F.array(F.lit(0)),
        lambda starts, at: F.when(
            F.get("sums", at + 1) - F.get("sums", F.element_at(starts, -1)) > room, F.concat(starts, F.array(at))
        ).otherwise(starts),
    )


def _with_system(turns: DataFrame) -> DataFrame:
    """Turns with their blocks; a system turn that begins its conversation also leads all blocks as a ``carried`` row.

    ``own``: the block is the one in which the turn itself stands.
    """
    rows = turns.withColumn("block", F.expr(f"turn div {BLOCK}"))
    text = F.when(F.col("role") == "system", F.col("text")).alias("text")
    narrow = rows.select("conv_id", "block", "turn", "role", text)
    first = F.min(F.struct("turn", "role", "text", "block")).alias("_first")
    opening = narrow.groupBy(F.col("conv_id").alias("_conv")).agg(first).where("_first.role = 'system'")
    blocks = narrow.select("conv_id", "block").distinct()
    carried = blocks.join(opening, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        "block",
        "_first.turn",
        "_first.role",
        "_first.text",
        F.lit(True).alias("carried"),
        F.col("block").eqNullSafe(F.col("_first.block")).alias("own"),
    )
    own = F.lit(False).alias("own")
    return rows.select("conv_id", "block", "turn", "role", "text", F.lit(False).alias("carried"), own).unionByName(carried)


def windows(
    conversations: DataFrame, budget: int = 512, history: int = 128, tokens: Column | None = None
) -> DataFrame:
    """(conv_id, block, part, window, n_turns, n_repeated, n_tokens, over_budget, text, loss): training windows.

    ``conversations``: conv_id, turn, role, text; other columns are not read. Turns stand by turn, null
    first, then by role and text; null roles and texts are empty; a null conv_id is a conversation;
    repeated rows are turns of their own. (block, part, window) is the order in a conversation. The first
    ``n_repeated`` of a window's ``n_turns`` turns stand in an earlier window too: the system turn, and up to
    ``history`` tokens of whole turns just before the new ones. ``loss``: (start, length) in characters of
    the new assistant texts as written. ``tokens`` measures ``text``; words by default. A window whose one
    new turn does not fit is ``over_budget``; nothing is cut or left out. An empty table gives no window.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id", "block").orderBy(
        F.col("carried").desc(), F.col("turn").asc_nulls_first(), "role", "text"
    )
    tokens = word_count(F.col("text")) if tokens is None else tokens
    lead = F.first(F.when(F.col("carried"), F.struct("own", "role", "text", "tokens"))).over(order)
    dealt = (
        _with_system(turns)
        .withColumn("tokens", tokens.cast("long"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("system", lead)
        .where("not carried")
        .withColumn("part", F.expr(f"place div {BLOCK}"))
    )
    blocks = dealt.groupBy("conv_id", "block", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text", "tokens"))).alias("turns"),
        F.first("system").alias("system"),
    )
    # The system turn itself is the second row of its block, after the carried one.
    begins = F.coalesce(F.col("system.own") & (F.get("turns", F.lit(0))["place"] == 2), F.lit(False))
    kept = F.when(begins, F.slice("turns", 2, F.size("turns"))).otherwise(F.col("turns"))
    blocks = blocks.select("conv_id", "block", "part", begins.alias("begins"), "system", kept.alias("turns"))
    blocks = blocks.withColumn("sums", _before(F.col("turns")))
    room = F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0))
    blocks = blocks.withColumn("room", room).withColumn("starts", _starts(F.col("room") - history))
    cut = blocks.select("*", F.posexplode("starts").alias("window", "start"))
    end = F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns"))
    cut = cut.withColumn("end", end)
    new_tokens = F.get("sums", F.col("end")) - F.get("sums", F.col("start"))
    spare = F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - new_tokens))
    since = F.filter(
        F.sequence(F.lit(0), F.col("start")), lambda at: F.get("sums", F.col("start")) - F.get("sums", at) <= spare
    )
    cut = cut.withColumn("since", F.array_min(since))
    taken = F.slice("turns", F.col("since") + 1, F.col("end") - F.col("since"))
    with_system = F.col("system").isNotNull()
    repeated = F.when(with_system & ~(F.col("begins") & (F.col("window") == 0)), 1).otherwise(0)
    n_repeated = F.col("start") - F.col("since") + repeated
    shown = F.transform(taken, lambda turn: F.struct(turn["role"].alias("role"), turn["text"].alias("text")))
    header = F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text"))
    shown = F.when(with_system, F.concat(F.array(header), shown)).otherwise(shown)
    n_tokens = F.get("sums", F.col("end")) - F.get("sums", F.col("since")) + F.coalesce(F.col("system.tokens"), F.lit(0))
    made = cut.select(
        "conv_id",
        "block",
        "part",
        "window",
        n_repeated.alias("n_repeated"),
        n_tokens.alias("n_tokens"),
        shown.alias("shown"),
    ).withColumn("written", F.transform("shown", _written))
    starts = F.aggregate(
        "written",
        F.array(F.lit(0)),
        lambda sums, text: F.concat(sums, F.array(F.element_at(sums, -1) + F.char_length(text))),
    )
    made = made.withColumn("at", starts)

    def span(turn: Column, number: Column) -> Column:
        head = F.char_length(F.lit(TURN_HEAD)) + F.char_length(escaped(turn["role"], True)) + 1
        length = F.char_length(escaped(turn["text"]))
        new = (turn["role"] == "assistant") & (number >= F.col("n_repeated"))
        return F.when(new, F.struct((F.get("at", number) + head).alias("start"), length.alias("length")))

    return made.select(
        "conv_id",
        "block",
        "part",
        "window",
        F.size("shown").alias("n_turns"),
        "n_repeated",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.array_join("written", "").alias("text"),
        F.filter(F.transform("shown", span), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with ``turns``, (role, text) of each new turn, and ``losses``, the texts under the loss mask.

    Both are read from the written text alone and unescaped; repeated turns are left out.
    """
    new = F.slice(F.split("text", TURN_TAIL), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = unescaped(F.substr(head, F.lit(len(TURN_HEAD) + 1)), True)
        text = unescaped(F.substr(piece, F.char_length(head) + 2))
        return F.struct(role.alias("role"), text.alias("text"))

    masked = F.transform("loss", lambda s: unescaped(F.substr("text", s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.transform(new, turn), "losses": masked})


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows.

    A digest needs its conversation's text in one value, which Spark limits to 2 GB; the windows are not limited.
    """
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read_back(formatted).select(
        "conv_id",
        F.struct(
            F.col("block").isNotNull().alias("timed"),
            F.coalesce("block", F.lit(0)).alias("block"),
            "part",
            "window",
            F.array_join(lines, "").alias("turns"),
            F.array_join("losses", "").alias("losses"),
        ).alias("said"),
        F.size("turns").alias("n_turns"),
        F.char_length("text").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list("said")).alias("said"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join("said.losses", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("said.turns", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
