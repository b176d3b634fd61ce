"""Chat formatting from event logs, in DataFrame functions throughout.

Events (conversation, turn, sequence number, kind, role, text) are folded into final messages: ``message`` begins a
message, ``delta`` adds to the current one, ``edit`` replaces its text, ``regenerate`` empties it for the deltas that
follow. Rendering: ``<s>``, then for each message ``[INST] role [/INST]text</s>``. Inside roles and texts ``&``, ``<``
and ``[`` are written ``&amp;``, ``&lt;`` and ``&lbr;``, so no control string can arise there, and ``parse`` reads
back what went in. The loss mask covers the assistant's texts; it is kept as runs of lengths.

A message is rendered before rows meet; a turn's pieces are joined in blocks of ``BLOCK`` messages, these in
blocks of ``BLOCK`` turns, these whole, so that a long conversation meets as few rows.

Defined results: a null text or role is empty; null kinds are messages; messages of one turn keep the order of
sequence, role and text, and repeated rows stay; a null turn comes first; a delta without a message begins one; an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
BLOCK = 64
ASSISTANT = "assistant"
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;")]


def escape(c: Column) -> Column:
    for plain, safe in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def reconstruct(events: DataFrame) -> DataFrame:
    """Events (conv_id, turn, seq, kind, role, text) to messages (conv_id, turn, msg, role, text)."""
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "role", "text", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("msg", F.greatest(F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(order), F.lit(1)))
    steps = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "kind")))
    folded = F.aggregate(
        "steps",
        F.lit(""),
        lambda s, x: F.when(x["kind"] == "delta", F.concat(s, x["text"])).when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"]),
    )
    return e.groupBy("conv_id", "turn", "msg").agg(steps.alias("steps")).select("conv_id", "turn", "msg", F.col("steps")[0]["role"].alias("role"), folded.alias("text"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns long, formatted string, loss array<struct<masked boolean, chars int>> (runs over ``formatted``, in order)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    run = lambda masked, chars: F.struct(masked.alias("masked"), chars.alias("chars"))
    piece = messages.select("conv_id", "turn", "msg", F.concat(F.lit(OPEN), role, F.lit(CLOSE)).alias("head"), text.alias("body"), (F.col("role") == ASSISTANT).alias("masked"))
    piece = piece.select("conv_id", "turn", "msg", F.concat("head", "body", F.lit(EOS)).alias("piece"), F.array(run(F.lit(False), F.char_length("head")), run(F.col("masked"), F.char_length("body")), run(F.lit(False), F.lit(len(EOS)))).alias("runs"))
    piece = piece.withColumn("n", F.lit(1).cast("long"))
    for keys in (["turn", F.floor(F.col("msg") / BLOCK).alias("b")], [F.floor(F.col("turn") / BLOCK).alias("b")]):
        joined = piece.groupBy("conv_id", *keys).agg(F.array_sort(F.collect_list(F.struct("turn", "msg", "piece", "runs", "n"))).alias("p"))
        piece = joined.select("conv_id", F.col("p")[0]["turn"].alias("turn"), F.col("p")[0]["msg"].alias("msg"), F.array_join(F.col("p.piece"), "").alias("piece"), F.flatten("p.runs").alias("runs"), _sum(F.col("p.n")).alias("n"))
    whole = piece.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "msg", "piece", "runs", "n"))).alias("p"))
    first = F.array(run(F.lit(False), F.lit(len(BOS))))
    return whole.select("conv_id", _sum(F.col("p.n")).alias("n_turns"), F.concat(F.lit(BOS), F.array_join(F.col("p.piece"), "")).alias("formatted"), F.concat(first, F.flatten("p.runs")).alias("loss"))


def parse(formatted: Column) -> Column:
    """The messages, array<struct<role, text>>, that a formatted conversation holds."""
    parts = F.split(F.substring(formatted, len(BOS) + 1, 2**31 - 1), EOS)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(F.substring_index(p, CLOSE, -1)).alias("text")))


def format_events(events: DataFrame) -> DataFrame:
    return render(reconstruct(events))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, array<string>, cut out by its runs; an error if the runs do not cover the messages."""
    parts = F.split(F.substring(formatted, len(BOS) + 1, 2**31 - 1), EOS)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    run = lambda i, k: F.get(loss, 3 * i + k + 1)
    fits = lambda p, i: (run(i, 0)["chars"] + run(i, 1)["chars"] == F.char_length(p)) & (run(i, 2)["chars"] == len(EOS))

    def cut(p: Column, i: Column) -> Column:
        head, body = run(i, 0), run(i, 1)
        text = F.concat(
            F.when(head["masked"], F.substring(p, F.lit(1), head["chars"])).otherwise(""),
            F.when(body["masked"], F.substring(p, head["chars"] + 1, body["chars"])).otherwise(""),
            F.when(run(i, 2)["masked"], F.lit(EOS)).otherwise(""),
        )
        return F.when(fits(p, i), unescape(text)).otherwise(F.raise_error(F.lit("the loss runs do not cover the messages")).cast("string"))

    whole = (F.size(loss) == 3 * F.size(parts) + 1) & (F.get(loss, F.lit(0))["chars"] == len(BOS))
    return F.when(whole, F.transform(parts, cut)).otherwise(F.raise_error(F.lit("the loss runs do not cover the text")).cast("array<string>"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the formatted text: turns, and the text under the loss mask."""
    read = formatted.withColumn("messages", parse(F.col("formatted")))
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("loss")), "")
    read = read.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("l"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars")
