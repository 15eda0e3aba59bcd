"""Chat formatting from an event log, in built-in functions only.

A log holds the events of conversations: whole messages, streamed deltas, edits, regenerations. Events are
partitioned by conversation, sorted by turn and sequence, folded into final messages and rendered with a
template. Every step works on disjoint slices of the sorted array, so it is linear in the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``### role: text</turn>`` and a line end for each message. In roles and texts the characters that the
#: template's control strings are made of are written with a backslash and a letter, so no control string
#: can occur inside a text, and replacing them backwards gives the text again.
OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
LOSS_ROLE = "assistant"


def sql(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escaped(value: str) -> str:
    for plain, code in ESCAPES:
        value = f"replace({value}, {sql(plain)}, {sql(code)})"
    return value


def unescaped(value: str) -> str:
    for plain, code in reversed(ESCAPES):
        value = f"replace({value}, {sql(code)}, {sql(plain)})"
    return value


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished messages as events: one ``message`` a row, in the order of ``turn``."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("op"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, messages array<struct<role, text>>`` from ``conv_id, turn, seq, op, role, text``.

    Events of a turn are taken by ``seq``: ``message`` starts a message with its text; ``delta`` adds its
    text to the message of its turn, starting one if there is none; ``edit`` replaces the text so far;
    ``regenerate`` empties it, so that only later deltas count; ``retract`` withdraws the message. Other
    values of ``op`` do nothing. The role is that of the message's first event. A NULL text is empty, a
    NULL turn or sequence comes first; ties go by ``op``, ``role`` and ``text``. Repeated ``message`` rows
    are messages of their own. A conversation whose messages are all withdrawn has an empty array. A NULL
    ``conv_id`` is a conversation like any other. One conversation is one output row and must fit in one.
    """
    log = events.select(
        F.col("conv_id"),
        F.expr(
            "struct(turn, seq, op, coalesce(role, '') as role, coalesce(text, '') as text)"
        ).alias("event"),
    )
    sorted_log = log.groupBy("conv_id").agg(F.sort_array(F.collect_list("event")).alias("e"))
    starts = (
        "filter(sequence(1, size(e)), i -> i = 1 or not (e[i - 1].turn <=> e[i - 2].turn) or e[i - 1].op = 'message')"
    )
    spans = "zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> struct(a as a, coalesce(b, size(e) + 1) as b))"
    # the last event of the message that replaces what came before it
    reset = (
        "array_max(filter(sequence(s.a - 1, s.b - 2), i -> e[i].op in ('message', 'edit', 'regenerate', 'retract')))"
    )
    text = (
        "concat_ws('', transform(sequence(coalesce(s.r, s.a - 1), s.b - 2), i -> "
        "if(e[i].op in ('message', 'edit', 'delta'), e[i].text, '')))"
    )
    return (
        sorted_log.withColumn("starts", F.expr(starts))
        .withColumn("spans", F.expr(spans))
        .withColumn("cuts", F.expr(f"transform(spans, s -> struct(s.a as a, s.b as b, {reset} as r))"))
        .withColumn(
            "messages",
            F.expr(
                "transform(filter(cuts, s -> not (s.r is not null and e[s.r].op = 'retract' and not exists("
                "sequence(s.r, s.b - 2), i -> e[i].op = 'delta'))), "
                f"s -> struct(e[s.a - 1].role as role, {text} as text))"
            ),
        )
        .select("conv_id", "messages")
    )


def render(folded: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask``: the text and, for each message, the code points before and in its text.

    ``mask`` is ``array<struct<skip, take, loss>>`` in order: ``skip`` code points of template, then ``take``
    of escaped text, which count for the loss when ``loss`` is true (the assistant's messages).
    """
    head = f"concat({sql(OPEN)}, {escaped('m.role')}, {sql(ROLE_END)})"
    rendered = folded.withColumn(
        "parts",
        F.expr(f"transform(messages, m -> struct({head} as head, {escaped('m.text')} as body, m.role = {sql(LOSS_ROLE)} as loss))"),
    )
    return rendered.select(
        "conv_id",
        F.expr(f"array_join(transform(parts, p -> concat(p.head, p.body, {sql(CLOSE)})), '')").alias("formatted"),
        F.expr(
            "transform(parts, (p, i) -> struct("
            f"length(p.head) + if(i = 0, 0, {len(CLOSE)}) as skip, length(p.body) as take, p.loss as loss))"
        ).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Messages and loss text recovered from ``formatted`` and ``mask`` alone."""
    close = CLOSE.replace("\n", "\\n")
    lines = f"slice(split(formatted, '{close}'), 1, size(mask))"
    role = unescaped(f"substring_index(substr(l, {len(OPEN) + 1}), {sql(ROLE_END)}, 1)")
    # the text is the part of the line that the mask takes, counted from its end
    body = unescaped("if(m.take = 0, '', right(l, m.take))")
    return rendered.withColumn("lines", F.expr(lines)).select(
        "conv_id",
        "formatted",
        F.expr(f"zip_with(lines, mask, (l, m) -> struct({role} as role, {body} as text, m.loss as loss))").alias("turns"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations; one row each.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. A NULL role is empty.
    An empty table gives no rows; other columns are ignored.
    """
    back = read_back(render(fold_events(events_of(conversations))))
    turns = "array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    loss = "array_join(transform(filter(turns, t -> t.loss), t -> t.text), '')"
    return back.withColumn("all_text", F.expr(turns)).withColumn("loss_text", F.expr(loss)).select(
        "conv_id",
        F.expr("cast(size(turns) as long)").alias("n_turns"),
        F.sha2("all_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_strings(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(extra)
