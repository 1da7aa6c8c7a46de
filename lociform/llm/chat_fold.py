"""Chat formatting from event logs: reconstruct final messages, render them, and read them back.

Events are (conv, seq, slot, kind, role, text): `message`, `edit` and `regenerate` set the text of a slot, `delta`
appends to it, `delete` removes the slot. A slot's final text is what was streamed since its last set event. All of
it is windows and grouped aggregates: a slot's events are ordered by sequence, each set event opens a new version,
and the last version's pieces are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks and the strings of other common templates that texts must not carry unescaped (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
SETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Percent-escape the first character of every control string, and % itself, so that unescape restores any text."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(("%3C" if c[0] == "<" else "%5B") + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("%3C"), F.lit("<")), F.lit("%5B"), F.lit("["))
    return F.replace(F.replace(out, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv, slot, role, text) of an event log.

    Order is by seq, ties by kind, role and text. A delta before any set event starts the slot's text; a later
    set event drops what came before; a role is the last one named; a slot whose last event is `delete` is gone.
    A null text is empty; unknown kinds count as deltas. Equal events are events each. An empty log gives no messages. Other
    columns are not read, whatever their names. A slot's events are one group, and render() makes one row of a conversation:
    that is the size of the result itself, and the one bound is that a conversation fits in a row.
    """
    slot = Window.partitionBy("conv", "slot")
    order = [F.col("seq"), F.col("kind"), F.col("role"), F.col("text")]
    upto = slot.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.select("conv", "slot", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.coalesce(F.col("kind").isin(*SETS, "delete"), F.lit(False)).cast("int")
    e = e.withColumn("version", F.sum(starts).over(upto)).withColumn("n", F.row_number().over(slot.orderBy(*order)))
    e = e.withColumn("last", F.max("version").over(slot)).withColumn("role", F.last("role", ignorenulls=True).over(upto)).where("version = last")
    g = e.groupBy("conv", "slot").agg(
        F.sort_array(F.collect_list(F.struct("n", "text", "kind", "role"))).alias("parts"),
    )
    g = g.select("conv", "slot", F.expr("element_at(parts, -1).role").alias("role"), F.expr("array_join(transform(parts, p -> p.text), '')").alias("text"), F.expr("exists(parts, p -> p.kind <=> 'delete')").alias("deleted"))
    return g.where("NOT deleted").drop("deleted")


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as an event log: one slot for each row, in the order of turn, role, text."""
    src = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return src.select("conv", F.row_number().over(w).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed(log: DataFrame) -> DataFrame:
    """The log of finished messages as it would have been streamed, with the same final texts: an assistant's message starts
    as a draft, is regenerated and comes in two deltas; another's is sent empty and edited."""
    half = F.floor(F.length("text") / 2).cast("int")
    assistant = F.col("role") == "assistant"
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    drafted = F.array(event(0, "message", F.lit("...")), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    edited = F.array(event(0, "message", F.lit("")), event(1, "edit", F.col("text")))
    return log.select("conv", "slot", "role", F.explode(F.when(assistant, drafted).otherwise(edited)).alias("e")).select("conv", "slot", "e.seq", "e.kind", "role", "e.text")


def render(final: DataFrame) -> DataFrame:
    """(conv, formatted, mask): each turn as OPEN role newline text CLOSE, texts and roles escaped; mask has, per turn in
    order, the code points from the turn's start to its text and the length of the text if it is under the loss."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("%0A")), F.lit("\n"))
    t = final.select("conv", "slot", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    g = t.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("slot", "head", "body", "loss"))).alias("turns"))
    return g.select(
        "conv",
        F.concat(F.expr("array_join(transform(turns, t -> concat(t.head, t.body)), '" + CLOSE.replace("\n", "\\n") + "')"), F.lit(CLOSE)).alias("formatted"),
        F.expr("transform(turns, t -> struct(length(t.head) AS skip, CASE WHEN t.loss THEN length(t.body) END AS size))").alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the formatted text says: turns, and the text under the loss mask, both unescaped. An empty table gives no rows;
    a conversation is one row, however long its texts are."""
    pieces = F.expr("slice(split(formatted, '" + OPEN.replace("|", "\\\\|") + "', -1), 2, 2147483647)")
    x = rendered.select("conv", "formatted", "mask", pieces.alias("pieces"))
    un = "replace(replace(replace(replace({}, '%3C', '<'), '%5B', '['), '%0A', '\\n'), '%25', '%')"
    body = f"substring(p, 1, length(p) - {len(CLOSE)})"
    role, text = un.format(f"substring_index({body}, '\\n', 1)"), un.format(f"substring({body}, instr({body}, '\\n') + 1)")
    turns = F.expr(f"array_join(transform(pieces, p -> concat({role}, '\\n', {text}, '\\n')), '')")
    masked = un.format(f"substring(z.pieces, z.mask.skip + 1 - {len(OPEN)}, z.mask.size)")
    loss = F.expr(f"array_join(transform(filter(arrays_zip(pieces, mask), z -> z.mask.size IS NOT NULL), z -> {masked}), '')")
    return x.select(
        "conv", F.size("pieces").cast("bigint").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def format_events(events: DataFrame) -> DataFrame:
    return render(fold(events))
