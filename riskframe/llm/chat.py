"""Chat formatting into budgeted training windows. DataFrame functions only.

Prefix sums of turn tokens cut every conversation into spans of whole turns; a
window is the conversation's system turn, a limited history of the turns before the
span, and the span. Repeated turns are context: the loss mask covers each assistant
text once, in the window whose span holds it.

Places and sums come from slim rows (no text): one range sort over all
conversations and totals by (sorted run, conversation), so a conversation that
holds a third of all rows is spread over tasks like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

BUDGET, HISTORY = 1024, 256
#: The template: a window opens with BEGIN; a turn is OPEN role CLOSE text END.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Beginnings of any control string, to be broken up inside texts.
_CONTROL = r"([<\[])(?=/?(?:s>|INST\]))"
SYSTEM, TARGET = "system", "assistant"


def escaped(text: Column) -> Column:
    """Text without control strings: backslashes are doubled, and one goes behind
    the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(role: Column, text: Column) -> Column:
    """Tokens that a turn is budgeted with: a quarter of its bytes, and four for its marks."""
    return (F.ceil((F.octet_length(role) + F.octet_length(text)) / 4) + 4).cast("long")


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Slim rows of numbered turns with their span: conv, part, at, system (is the
    leading system turn), start and end (prefix sums of tokens without it), span,
    stride, room (tokens that a window has for its span).

    Spans begin at multiples of half the room. The turn that crosses into the next
    multiple stays if the span then still fits the room, and is a span of its own
    otherwise; so no span exceeds the room unless a single turn does.
    """
    slim = turns.select("conv", "role", "tokens", "part", "at")
    first = F.struct("at", "role", "tokens")
    runs = slim.groupBy("part", "conv").agg(F.sum("tokens").alias("n"), F.min(first).alias("first"))
    by_run = Window.partitionBy("conv").orderBy("part")
    head = F.first("first").over(by_run)
    runs = materialise(runs.select("part", "conv", F.col("first.at").alias("from_at"), head.alias("head"), F.row_number().over(by_run).alias("nth"),
                                   F.coalesce(F.sum("n").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")), "runs")
    has = F.col("head.role") == SYSTEM
    runs = runs.select(F.col("part").alias("r_part"), F.col("conv").alias("r_conv"), "from_at", "nth", "ahead",
                       F.when(has, F.col("head.tokens")).otherwise(F.lit(0)).alias("head_tokens"), F.coalesce(has, F.lit(False)).alias("has"))
    s = slim.join(runs, (F.col("part") == F.col("r_part")) & F.col("conv").eqNullSafe(F.col("r_conv"))).drop("r_part", "r_conv")
    upto = Window.partitionBy("part", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = (s.withColumn("end", F.col("ahead") + F.sum("tokens").over(upto) - F.col("head_tokens")).withColumn("start", F.col("end") - F.col("tokens"))
         .withColumn("system", F.col("has") & (F.col("nth") == 1) & (F.col("at") == F.col("from_at")))
         .withColumn("room", F.greatest(F.lit(budget - history) - F.col("head_tokens"), F.lit(2))).withColumn("stride", F.expr("room div 2")))
    k = F.when(F.col("system"), F.lit(0)).otherwise(F.expr("start div stride"))
    alone = ~F.col("system") & (F.col("end") - k * F.col("stride") > F.col("room"))
    return s.select("conv", "part", "at", "system", "start", "end", "tokens", "stride", "room", (k * 2 + alone.cast("long")).cast("long").alias("span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, n_tokens, repeated, n_turns, over_budget, formatted, loss for
    every window of conversations (conv_id, turn, role, text).

    Turns of a conversation stand by turn (nulls first), rows that share one by role
    and md5 of the text; repeated rows are turns of their own. A null text or role is
    empty; rows without conv_id are one conversation. A leading system turn is new in
    the first window and repeated in the others; before a span stand the turns that
    ended within ``history`` tokens before it. formatted holds the template's text,
    its first ``repeated`` turns repeat earlier windows, and loss lists (start, length)
    in code points of the new assistant texts. Windows keep to the budget unless one
    turn exceeds what a window has for its span; that window has no history and
    over_budget is true. window numbers ascend but may skip some. An empty table has
    no windows; other columns, whatever their names, are not read. Very long texts
    are one turn, never cut.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    own = materialise(own.withColumn("tokens", turn_tokens(F.col("role"), F.col("text"))).withColumn("name", F.md5("text"))
                      .withColumn("row", F.monotonically_increasing_id()), "turns")
    turns = numbered(own, F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "name", "row", name="turns")
    s = materialise(_spans(turns, budget, history), "spans")
    spans = s.where("NOT system").groupBy("conv", "span").agg(
        F.min("start").alias("begins"), F.max("end").alias("ends"), F.max("room").alias("room"), F.max("stride").alias("stride"))
    spans = materialise(spans.withColumn("fits", F.col("ends") - F.col("begins") <= F.col("room")), "bounds")
    new = s.select("conv", "span", "part", "at", F.when(F.col("system"), F.lit(-1)).otherwise(F.col("start")).cast("long").alias("place"), F.lit(False).alias("again"))
    # history: a turn goes to the spans that begin within ``history`` tokens of its start
    past = (s.where((~F.col("system")) & (F.col("tokens") <= history))
            .withColumn("near", F.explode(F.expr(f"sequence(end div stride, (start + {history}L) div stride)"))).select("conv", "part", "at", "start", "end", "near"))
    b = spans.where("fits").select(F.col("conv").alias("b_conv"), F.col("span").alias("b_span"), "begins", F.expr("begins div stride").alias("b_near"))
    past = (past.join(b, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("near") == F.col("b_near"))
                      & (F.col("begins") >= F.col("end")) & (F.col("begins") - F.col("start") <= history))
            .select("conv", F.col("b_span").alias("span"), "part", "at", F.col("start").alias("place"), F.lit(True).alias("again")))
    heads = s.where("system").select(F.col("conv").alias("h_conv"), "part", "at")
    later = spans.where("span > 0").select("conv", "span").join(heads, F.col("conv").eqNullSafe(F.col("h_conv")))
    later = later.select("conv", "span", "part", "at", F.lit(-1).cast("long").alias("place"), F.lit(True).alias("again"))
    placed = new.union(past).union(later)

    body = turns.select("part", "at", "role", "tokens", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)).alias("head"), escaped(F.col("text")).alias("body"))
    members = placed.join(body, ["part", "at"])
    # no "again" in a span's own turns is before one that is: history and the system turn are in front
    w = members.groupBy("conv", "span").agg(F.sort_array(F.collect_list(F.struct("place", "again", "role", "head", "body", "tokens"))).alias("turns"))
    step = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def walk(acc: Column, t: Column) -> Column:
        begins, size = acc["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        masked = F.when((t["role"] == TARGET) & ~t["again"], F.array(F.struct(begins.alias("start"), size.alias("length")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
        return F.struct((begins + size + len(END)).alias("at"), F.concat(acc["loss"], masked).alias("loss"))

    said = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    return w.select(F.col("conv").alias("conv_id"), F.col("span").alias("window"), total.alias("n_tokens"),
                    F.size(F.filter("turns", lambda t: t["again"])).alias("repeated"), F.size("turns").alias("n_turns"), (total > budget).alias("over_budget"),
                    F.concat(F.lit(BEGIN), F.array_join(said, "")).alias("formatted"),
                    F.aggregate("turns", step, walk, lambda acc: acc["loss"]).alias("loss"))


def turns_of(formatted: Column, repeated: Column) -> Column:
    """The (role, text) turns that a formatted window adds to its conversation."""
    parts = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END)
    own = F.slice(parts, repeated + 1, F.size(parts) - 1 - repeated)
    return F.transform(own, lambda t: F.struct(
        unescaped(F.substring(F.substring_index(t, CLOSE, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
        unescaped(F.substring(t, F.length(F.substring_index(t, CLOSE, 1)) + len(CLOSE) + 1, F.lit(2**31 - 1))).alias("text")))


def read_back(w: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed
    from windows' formatted text and loss masks.

    The digests are of a conversation's whole text, so here, and only here, a
    conversation's turns meet in one row; Spark holds at most 2 GB in one value.
    """
    new = turns_of(F.col("formatted"), F.col("repeated"))
    told = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    parts = w.select("conv_id", "window", F.size(new).cast("long").alias("n"), told.alias("told"), masked.alias("masked"), F.length("formatted").cast("long").alias("chars"))
    c = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("masked")).alias("loss_chars"),
                                     F.sort_array(F.collect_list(F.struct("window", "told", "masked"))).alias("w"))
    return c.select("conv_id", "n_turns", F.sha2(F.array_join("w.told", ""), 256).alias("turns_sha256"), "loss_chars",
                    F.sha2(F.array_join("w.masked", ""), 256).alias("loss_sha256"), "formatted_chars")


def with_control_case(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) and conversation -1, whose texts are control strings."""
    said = f"{END}{OPEN} ok {CLOSE}"
    case = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, TARGET, said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(case)
