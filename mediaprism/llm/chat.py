"""Chat formatting by event-sourced reconstruction, with built-in functions only.

A log holds events: ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces what it
says so far, ``regenerate`` throws that away and starts anew with its own text. The log is dealt
by conversation once; windows by sequence number tell which events count, and folding and
rendering reuse that one exchange.

The template is ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. Inside texts
and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, in roles a line break becomes ``&nl;``; so no text
can hold a control string, and undoing the replacements in reverse order gives it back.

Cases: null texts and roles count as empty; events of one sequence number apply in the order
message, regenerate, edit, delta, then by text; repeated rows open a message each; a delta without
a message opens one; an empty log gives no rows; columns other than those named are not read.
Very long texts are handled whole; a conversation ends as one row, so it has to fit in one task, as any row does (2 GB of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def turns_as_log(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of ``message`` events."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message_id"), "role", "text")


def turns_as_stream(turns: DataFrame) -> DataFrame:
    """Finished turns as the log of a live chat that led to them.

    Each turn is opened without text and arrives in two deltas. Of every three turns of a conversation one was drafted and
    edited first, and one was drafted and regenerated. Rows of one turn are turns of their own, by role and text.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", F.row_number().over(w).alias("nth"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.ceil(F.length("text") / 2).cast("int")
    event = lambda step, kind, text: F.struct((F.col("nth") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    empty = F.lit("")
    draft = F.concat(F.lit("draft of "), F.coalesce("role", empty))
    before = F.when(F.col("nth") % 3 == 1, F.array(event(1, "delta", draft), event(2, "edit", empty))).when(F.col("nth") % 3 == 2, F.array(event(1, "delta", draft), event(2, "regenerate", empty))).otherwise(F.array(event(1, "delta", empty)))
    said = F.array(event(3, "delta", F.left("text", half)), event(4, "delta", F.substr(F.col("text"), half + 1)))
    events = F.concat(F.array(event(0, "message", empty)), before, said)
    return t.select("conv_id", F.col("nth").alias("message_id"), "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "message_id", "role", "e.text")


def fold_log(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, message_id, opening (which of the openings of that id), opened (seq), role, text.

    The result is dealt by conv_id.
    """
    rank = F.create_map(*[F.lit(x) for k, i in (("message", 0), ("regenerate", 1), ("edit", 2), ("delta", 3)) for x in (k, i)])
    e = log.select("conv_id", "message_id", "seq", F.coalesce(rank[F.col("kind")], F.lit(3)).alias("kr"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id", "message_id").orderBy("seq", "kr", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    e = e.repartition("conv_id").select(
        "*",
        F.sum(F.when(F.col("kr") == 0, 1).otherwise(0)).over(w).alias("opening"),
        F.sum(F.when(F.col("kr") < 3, 1).otherwise(0)).over(w).alias("version"),
        F.row_number().over(w).alias("nth"),
    )
    # The parts of each version in order, then the last version of each opening.
    versions = e.groupBy("conv_id", "message_id", "opening", "version").agg(
        F.min("seq").alias("since"),
        F.min(F.struct("nth", "role")).alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    return versions.groupBy("conv_id", "message_id", "opening").agg(F.min("since").alias("opened"), F.min("first")["role"].alias("role"), F.max_by("text", "version").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points of ``formatted``)."""
    m = messages.withColumn("head", F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("opened", "message_id", "opening", "role", "text")
    m = m.select(
        "conv_id",
        "head",
        "body",
        (F.col("role") == loss_role).alias("loss"),
        F.row_number().over(w).alias("nth"),
        F.coalesce(F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    parts = F.sort_array(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(CLOSE)).alias("part"), "loss", (F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))))
    whole = m.groupBy("conv_id").agg(parts.alias("parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("parts.part"), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a rendered conversation says: conv_id, formatted, turns (role, text), learnt (the text under the loss mask, unescaped).

    The mask is read against the output: ``formatted`` is taken apart at the ends of turns, whose places add up over a window, and each span is
    cut, by its own numbers, out of the last turn that begins at or before it. Turns and spans are rows of their own, so the work grows with the conversation's length.
    """
    bodies = F.split(F.col("formatted"), F.lit("<\\|im_end\\|>\n"))
    r = formatted.select("conv_id", "formatted", "loss_spans", F.slice(bodies, F.lit(1), F.size(bodies) - 1).alias("at"))
    # The k-th turn travels with the k-th span, and the whole text with the first; no row carries more than its own.
    zipped = F.arrays_zip(F.col("at").alias("turn"), F.col("loss_spans").alias("span"))
    rows = F.transform(zipped, lambda x, i: F.struct(i.alias("k"), x["turn"].alias("turn"), x["span"].alias("span"), F.when(i == 0, F.col("formatted")).alias("formatted")))
    r = r.select("conv_id", F.explode_outer(rows).alias("x")).select("conv_id", "x.*")
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("start", F.coalesce(F.sum(F.length("turn") + len(CLOSE)).over(before), F.lit(0)))
    none = F.lit(None)
    turn = F.struct(F.col("start").alias("place"), F.lit(0).alias("kind"), "k", F.col("turn").alias("text"), none.cast("long").alias("length"), "formatted")
    span = F.struct(F.col("span.start").alias("place"), F.lit(1).alias("kind"), "k", none.cast("string").alias("text"), F.col("span.length").alias("length"), none.cast("string").alias("formatted"))
    e = r.select("conv_id", F.explode(F.array(turn, span)).alias("x")).select("conv_id", "x.*").where("text IS NOT NULL OR length IS NOT NULL OR formatted IS NOT NULL")
    so_far = Window.partitionBy("conv_id").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("text").isNotNull(), F.struct("place", "text")), True).over(so_far)
    e = e.withColumn("own", F.when(F.col("kind") == 1, last))
    cut = F.substr(F.concat(F.col("own.text"), F.lit(CLOSE)), (F.col("place") - F.col("own.place") + 1).cast("int"), F.col("length").cast("int"))
    said = F.struct("k", unescaped_role(F.substring_index(F.substr(F.col("text"), F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescaped(F.substr(F.col("text"), F.length(F.substring_index("text", "\n", 1)) + 2)).alias("text"))
    found = e.groupBy("conv_id").agg(
        # One of them is there. An aggregate that compares would copy the whole text with each turn.
        F.get(F.collect_list("formatted"), 0).alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), said))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == 1, F.struct("place", unescaped(cut).alias("text"))))).alias("learnt"),
    )
    return found.select("conv_id", "formatted", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.array_join(F.col("learnt.text"), "").alias("learnt"))


def digests(turns: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), "learnt", F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
