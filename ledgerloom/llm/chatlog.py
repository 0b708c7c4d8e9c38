"""Chat formatting by event-sourced reconstruction, with DataFrame functions alone.

A conversation is a log of events.  Each names a message and is of one kind: ``message`` (a whole
text), ``delta`` (text to append), ``edit`` (a new text in place of the old), ``regenerate`` (the
old text goes; deltas that follow build the new one) or ``delete``.  The log is partitioned by
conversation and message, sorted by sequence and folded to the final text, so that the streamed
deltas of a long log are combined before anything meets in one row.  Then the final messages of a
conversation are rendered in order.

The template wraps each turn in ``<s>`` and ``</s>``: user turns as ``[INST] text [/INST]``, system
turns as ``[SYS] text [/SYS]``, assistant turns bare, any other role as ``[ROLE]role[/ROLE]text``.
A control string inside a text gets a backslash after its first character, and a backslash is
doubled, so no text holds a control string and the texts can be read back.

Defined results: a null text is empty; a null role is the empty role; a null kind is ``message``;
events without a conversation form one of their own (null conv_id); a message none of whose events
carries text is an empty turn; deleted messages leave no turn; ties in sequence fold in the order
of kind, then text, so a whole message that the log repeats counts once, while a repeated delta is
appended again; other columns play no part; an empty log gives no conversations.  A conversation of
any length is rendered whole, in one row, as its output is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A backslash, or a control string of the template, with its first character apart.
CONTROL = r"\\|(?:<)(?=/?s>)|(?:\[)(?=/?(?:INST|SYS|ROLE)\])"
#: Kinds of event that set a text anew.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Reversibly break up the control strings inside a text."""
    return F.regexp_replace(text, f"({CONTROL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|<|\[)\\", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message (its key), role, text.  ``events`` needs conv_id, message, seq, kind, role, text."""
    kind = F.coalesce("kind", F.lit("message"))
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct(F.col("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role")))).alias("log"))
    texts = F.expr(f"aggregate(log, -1, (at, e) -> at + 1, n -> n)")  # last index of the log
    last = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(F.lit(0)))), F.lit(0))
    alive = F.slice("log", F.col("start") + 1, F.greatest(texts - F.col("start") + 1, F.lit(0)))
    out = log.withColumn("start", last).withColumn("alive", alive)
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    return out.where(~F.exists("log", lambda e: e["kind"] == "delete")).select("conv_id", "message", F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).alias("role"), F.array_join(F.transform("alive", lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start and end of the assistants' texts in it, code points)."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    open_, close = (
        F.when(role == "user", user).when(role == "system", system).when(role == "assistant", F.lit("")).otherwise(other)
        for user, system, other in ((F.lit("[INST] "), F.lit("[SYS] "), F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"))), (F.lit(" [/INST]"), F.lit(" [/SYS]"), F.lit("")))
    )
    turn = messages.select("conv_id", "message", F.concat(F.lit("<s>"), open_, text, close, F.lit("</s>")).alias("turn"), (role == "assistant").alias("loss"))
    chats = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "turn", "loss"))).alias("turns"))
    step = "struct(s.at + length(t.turn) as at, if(t.loss, concat(s.spans, array(struct(s.at + 3 as start, s.at + length(t.turn) - 4 as end))), s.spans) as spans)"
    spans = F.expr(f"aggregate(turns, struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as spans), (s, t) -> {step}, s -> s.spans)")
    return chats.select("conv_id", F.array_join(F.col("turns.turn"), "").alias("formatted"), spans.alias("loss_spans"))


def parse(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, turns (array of role and text), formatted, loss_text."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda p: F.startswith(p, F.lit("<s>")))

    def turn(p: Column) -> Column:
        body = F.substring(p, 4, 2**31 - 1)
        named = F.startswith(body, F.lit("[ROLE]"))
        end = F.instr(body, "[/ROLE]")

        def inner(prefix: int, suffix: int) -> Column:
            return body.substr(F.lit(prefix + 1), F.length(body) - prefix - suffix)

        user, system = F.startswith(body, F.lit("[INST] ")), F.startswith(body, F.lit("[SYS] "))
        role = F.when(user, F.lit("user")).when(system, F.lit("system")).when(named, unescape(body.substr(F.lit(7), end - 7))).otherwise(F.lit("assistant"))
        text = F.when(user, inner(7, 8)).when(system, inner(6, 7)).when(named, body.substr(end + 7, F.length(body))).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))), "")
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), "formatted", loss.alias("loss_text"))
