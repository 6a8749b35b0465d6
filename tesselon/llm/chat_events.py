"""Chat formatting: event-sourced reconstruction, then rendering, in DataFrame functions only.

An event log has one row per event: conversation, message position, sequence number, kind, role
and text.  Kinds: ``message`` (the whole text), ``delta`` (text appended), ``edit`` (text
replaced), ``regenerate`` (text replaced, and all later messages dropped that were last written
whole before it) and ``retract`` (message removed).  Any other or null kind counts as ``message``.

Rendering marks turns as ``<turn:role>text</turn>\\n``.  Inside roles and texts ``\\ < > [ ]`` are
written as a backslash and a digit, so no control string of this or another template survives in
a text, and replacing the codes (backslash last) gives the text back exactly.

``event_log`` makes a log of stored turns: texts arrive in streamed pieces, behind drafts that an
edit or a regeneration replaces, amid follow-ups that a regeneration drops and messages that are
retracted, in no order.  Folding it gives the turns back.

Cases: null texts and roles count as empty; equal rows of one position are separate turns; ties in
the sequence are ordered by whole before delta, then role and text; a null position comes first and
is dropped by no regeneration; an empty log gives no conversations; a null conversation id is a
conversation of its own; columns other than those named are not read.  A conversation is one output
row, so its rendered text is bounded by Spark's 2 GB a value; until that last step long
conversations are folded in blocks of ``BLOCK`` positions in many tasks, and one task sees one
number a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Control characters in the order of their codes; the backslash is code 0.
CONTROL = "\\<>[]"
END = "</turn>\n"


#: Sequence numbers of one turn's events, pieces that a text is streamed in at most, and where late edits begin.
STEP, PIECES, LATE = 1 << 20, 12, 1 << 62


def _event(position, seq, kind: str, role, text) -> Column:
    return F.struct(position.cast("long").alias("position"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))


def _streamed(position, seq, text) -> Column:
    """Deltas of a text from sequence number ``seq`` on."""
    length = F.greatest(F.ceil(F.length(text) / PIECES), F.lit(24)).cast("int")
    count = F.greatest(F.ceil(F.length(text) / length), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _event(position, seq + i, "delta", F.lit(None).cast("string"), F.substring(text, i * length + 1, length)))


def event_log(rows: DataFrame) -> DataFrame:
    """A log (conv_id, position, seq, kind, role, text) whose fold is the turns of ``rows``: conv_id, turn, role, text.

    A turn has position 2 * turn, what is dropped or retracted after it the position behind.  Which
    history a turn has depends on a hash of its conversation and number; turns that share these are
    written whole.
    """
    texts = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = Window.partitionBy("conv_id", "turn")
    texts = texts.withColumn("way", F.when((F.count(F.lit(1)).over(place) > 1) | F.col("turn").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))))
    at, seq, role, text = F.col("turn") * 2, F.col("turn") * STEP, F.col("role"), F.col("text")
    draft, empty = F.concat(F.lit("draft: "), F.reverse(F.substring("text", 1, 60))), F.lit("")
    ways = [
        F.array(_event(at, seq, "message", role, text)),
        F.concat(F.array(_event(at, seq, "message", role, empty)), _streamed(at, seq + 1, text)),
        F.concat(F.array(_event(at, seq, "message", role, draft)), _streamed(at, seq + 1, draft), F.array(_event(at + 1, seq + 100, "message", role, draft), _event(at + 1, seq + 101, "retract", role, empty), _event(at, seq + LATE, "edit", role, text))),
        F.concat(
            F.array(_event(at, seq, "message", role, empty)),
            _streamed(at, seq + 1, draft),
            F.array(_event(at + 1, seq + 100, "message", role, draft), _event(at + 2, seq + 101, "message", role, draft), _event(at, seq + 102, "regenerate", role, empty)),
            _streamed(at, seq + 103, text),
        ),
    ]
    events = ways[0]
    for i, way in enumerate(ways[1:], 1):
        events = F.when(F.col("way") == i, way).otherwise(events)
    mixed = F.array_sort(F.transform(events, lambda e: F.struct(F.xxhash64(e["position"], e["seq"]).alias("o"), e.alias("e"))))
    return texts.select("conv_id", F.explode(mixed).alias("m")).select("conv_id", "m.e.*")


def escape(text: Column) -> Column:
    for code, char in enumerate(CONTROL):
        text = F.replace(text, F.lit(char), F.lit(f"\\{code}"))
    return text


def unescape(text: Column) -> Column:
    for code, char in reversed(list(enumerate(CONTROL))):
        text = F.replace(text, F.lit(f"\\{code}"), F.lit(char))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log with conv_id, position, seq, kind, role, text: conv_id, position, role, text, copies.

    ``copies`` counts equal complete ``message`` events of one position and sequence number.
    """
    events = events.select("conv_id", "position", "seq", "kind", "role", "text")
    kinds = ("delta", "edit", "regenerate", "retract")
    log = events.withColumns({"kind": F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("message"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    # One exchange by position serves all that follows up to the messages.
    log = log.repartition("conv_id", "position").groupBy("conv_id", "position", "seq", "kind", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    one = Window.partitionBy("conv_id", "position")
    whole = F.col("kind") != "delta"
    part = F.when(whole, F.lit(0)).otherwise(F.lit(1))
    latest = lambda which: F.max(F.when(which, F.col("seq"))).over(one)
    log = (
        log.withColumn("began", F.coalesce(latest(F.col("kind").isin("message", "regenerate")), F.min("seq").over(one)))
        .withColumn("base", latest(whole))
        .withColumn("redone", latest(F.col("kind") == "regenerate"))
        .filter("base is null or seq >= base or seq is null")
        .withColumn("dead", F.max((F.col("kind") == "retract").cast("int")).over(one))
        .withColumn("named", F.min(F.when(F.col("role") != "", F.struct(part, "seq", "role"))).over(one)["role"])
        .withColumn("plain", F.max(F.when(F.col("kind") != "message", 1).otherwise(0)).over(one) == 0)
    )
    # Whole messages of one position stay rows of their own; other positions fold their pieces in order.
    pieces = F.array_sort(F.collect_list(F.struct("seq", part.alias("part"), "role", "text", "copies")))
    told = F.array_join(F.transform(pieces, lambda p: F.repeat(p["text"], p["copies"].cast("int"))), "")
    messages = log.groupBy("conv_id", "position", "plain", F.when(F.col("plain"), F.struct("role", "text")).alias("own")).agg(
        F.coalesce(F.first("named"), F.lit("")).alias("named"),
        told.alias("told"),
        F.sum("copies").alias("copies"),
        F.min("began").alias("began"),
        F.max("redone").alias("cut"),
        F.max("dead").alias("dead"),
    )
    messages = messages.select(
        "conv_id",
        "position",
        F.floor(F.col("position") / BLOCK).alias("block"),
        F.when(F.col("plain"), F.col("own.role")).otherwise(F.col("named")).alias("role"),
        F.when(F.col("plain"), F.col("own.text")).otherwise(F.col("told")).alias("text"),
        F.when(F.col("plain"), F.col("copies")).otherwise(F.lit(1)).alias("copies"),
        "began",
        "cut",
        "dead",
    )
    # A regeneration drops later positions that began before it: of each position, the last regeneration of any
    # position before it counts, in its block by a window, beyond it by a mark before the block's first position.
    redone = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    blocks = events.filter("position is not null").groupBy("conv_id", F.floor(F.col("position") / BLOCK).alias("block")).agg(redone.alias("cut"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = blocks.select("conv_id", (F.col("block") * BLOCK - 1).alias("position"), "block", F.max("cut").over(upto).alias("cut")).filter("cut is not null")
    before = Window.partitionBy("conv_id", "block").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    near = messages.unionByName(marks, allowMissingColumns=True).withColumn("near", F.max("cut").over(before))
    dropped = F.col("position").isNotNull() & (F.col("near") > F.col("began"))
    return near.filter("dead = 0").filter(~F.coalesce(dropped, F.lit(False))).select("conv_id", "position", "role", "text", "copies")


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its formatted text."""
    turn = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"), escape(F.col("text")), F.lit(END))
    blocks = messages.groupBy("conv_id", F.floor(F.col("position") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "role", "text", F.repeat(turn, F.col("copies").cast("int")).alias("out")))).alias("turns"))
    blocks = blocks.select("conv_id", "block", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("out"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "out"))).alias("blocks"))
    return whole.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["out"]), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read turns back: adds ``turns``, an array of role and text; those of the role assistant bear the loss."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<turn:([^>]*)>", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^<turn:[^>]*>(.*)$", 1)).alias("text"),
        ),
    )
    return formatted.withColumn("turns", turns)


def turn_digests(parsed: DataFrame) -> DataFrame:
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return parsed.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
