"""Chat formatting: event-sourced reconstruction of conversations, rendered with a loss mask.

A log holds events ``(conv_id, seq, msg, kind, role, text)``. They are grouped by conversation and
message, sorted by ``seq`` and folded:

* ``message`` sets the message's text, ``edit`` replaces it, ``regenerate`` starts it anew;
* ``delta`` appends streamed text to what the last of those left.

Template: every turn is ``<turn:ROLE>TEXT</turn>\\n``. In roles and texts a backslash is written
``\\s``, ``<`` is written ``\\l`` and (roles only) ``>`` is written ``\\g``; so no text can hold a turn
mark, and reading back is exact. Everything is DataFrame functions.

Defined results: a null text is empty, a null role is the empty role, a null ``seq`` sorts first;
events that tie in ``seq`` fold in the order of kind, role and text; turns that tie in ``turn`` come in the
order of the MD5 of their role, then of the SHA-256 of their text; a repeated event counts again;
an empty log gives no rows; further columns of the log are ignored; null ``conv_id`` is a conversation;
bytes of a role or text that are no UTF-8 become U+FFFD, so that the mask's counts hold for ``formatted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def events_from_turns(turns: DataFrame) -> DataFrame:
    """Each row of ``(conv_id, turn, role, text)`` as one ``message`` event; repeated rows stay apart."""
    same = turns.repartition("conv_id").select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return (
        same.groupBy("conv_id", "seq", "role", "text").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("conv_id", "seq", F.concat_ws("/", "seq", F.md5("role"), F.sha2("text", 256), "again").alias("msg"), F.lit("message").alias("kind"), "role", "text")
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """One row per message ``(conv_id, msg, seq, role, text)``: its first ``seq``, role and final text."""
    log = events.select(
        "conv_id", "msg", F.struct("seq", F.col("kind").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e")
    )
    folded = log.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("log"))
    from_ = F.greatest(F.array_max(F.transform("log", lambda e, i: F.when(e.kind == "delta", F.lit(-1)).otherwise(i))), F.lit(0))
    live = F.slice("log", from_ + 1, F.size("log"))
    return folded.select(
        "conv_id", "msg", F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"), F.array_join(F.transform(live, lambda e: e.text), "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_mask``.

    ``loss_mask`` has one run-length triple per turn, in characters of ``formatted``: header (masked),
    text under the loss (assistant turns; else 0), rest (masked).
    """
    turn = F.struct("seq", "msg", F.make_valid_utf8("role").alias("role"), F.make_valid_utf8("text").alias("text"))
    convs = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("<turn:"), escape_role(t.role), F.lit(">"))
    piece = lambda t: F.struct(head(t).alias("head"), escape(t.text).alias("said"), (t.role == "assistant").alias("under"))
    pieces = convs.select("conv_id", F.transform("turns", piece).alias("pieces"))
    under = lambda p: F.when(p.under, F.length(p.said)).otherwise(F.lit(0))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.said, F.lit(END))), "").alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(F.length(p.head).alias("skip"), under(p).alias("take"), (F.length(p.said) - under(p) + len(END)).alias("tail")),
        ).alias("loss_mask"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """The operator: fold the log, then render each conversation.

    The log is dealt once, by conversation; folding by message and rendering keep that partitioning.
    """
    return render(fold_messages(events.repartition("conv_id")))


def split_turns(formatted: Column) -> Column:
    """The turns of ``formatted``, each without its end mark."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def read_parts(parts: Column) -> Column:
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len("<turn:") + 1)), ">", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, ">") + 1)).alias("text"),
        ),
    )


def read_turns(formatted: Column) -> Column:
    """Reads ``formatted`` back as ``array<struct<role, text>>``."""
    return read_parts(split_turns(formatted))


def read_loss(parts: Column, loss_mask: Column) -> Column:
    """Reads the text under ``loss_mask``, unescaped, from the turns of ``split_turns``.

    A triple of the mask spans one turn, so it is applied within it: in linear time, which positions in
    all of ``formatted`` are not. A mask that doesn't cover ``formatted`` turn by turn is an error.
    """
    fits = lambda p, m: F.length(p) + len(END) == m.skip + m.take + m.tail
    run = lambda p, m: F.substr(F.concat(p, F.lit(END)), m.skip + 1, m.take)
    wrong = F.raise_error(F.lit("loss_mask does not cover formatted"))
    runs = F.zip_with(parts, loss_mask, lambda p, m: F.when(fits(p, m), run(p, m)).otherwise(wrong))
    return unescape(F.array_join(runs, ""))


def chat_digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of the turns, read back from ``formatted``, and of its text under ``loss_mask``."""
    parts = chats.select("conv_id", "formatted", "loss_mask", split_turns(F.col("formatted")).alias("parts"))
    read = parts.select("conv_id", "formatted", read_parts(F.col("parts")).alias("turns"), read_loss(F.col("parts"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
