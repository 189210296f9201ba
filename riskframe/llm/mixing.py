"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time. Its integral is the
source's cumulative token demand; inverting it turns a place in the source's
token stream into a training position, and the mix is the documents range-sorted
by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread

#: Relative weight of a source at time 0, 1/2 and 1, by its rank: early, flat, late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " +"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size), one row per
    source: sources by code point (null last) weigh ``weights``, repeating, and
    share the sum of all sizes; a target stops at max_repeat times its source's
    size and the excess is reshared by weight until none is above.

    Filling is solved in closed form: sources sorted by the level at which they
    fill up; the final level is the first one that fills no further source (the
    levels after it only fall). The windows run over one row per source.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = (sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
         .withColumn("w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
         .withColumn("full", F.col("source_size") * float(max_repeat))
         .withColumn("level", F.col("full") / F.col("w")))
    order = Window.orderBy("level", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("reach", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(rest))
         .withColumn("ends", F.when(F.col("reach") <= F.col("level"), F.col("reach")))
         .withColumn("final", F.max("ends").over(everything)))
    return s.select("source", "rank", "source_size",
                    F.least(F.col("full"), F.col("w") * F.coalesce("final", F.lit(float("inf")))).alias("target"))


def _position(share: Column, schedule: Column) -> Column:
    """Training time t in [0, 1] at which a source has spent ``share`` of its
    demand: the schedule (a, b, c) is linear between t = 0, 1/2 and 1, so its
    integral is quadratic on each half and is inverted in closed form."""
    a, b, c = schedule[0], schedule[1], schedule[2]
    half, whole = (a + b) / 4, (a + 2 * b + c) / 4
    need = share * whole
    def inverse(y0: Column, y1: Column, area: Column) -> Column:
        # y0 x + (y1 - y0) x^2 = area, in the form that is stable for equal ends
        return F.when(area <= 0, F.lit(0.0)).otherwise(2 * area / (y0 + F.sqrt(F.greatest(y0 * y0 + 4 * (y1 - y0) * area, F.lit(0.0)))))
    return F.when(need <= half, inverse(a, b, need)).otherwise(0.5 + inverse(b, c, need - half))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = MAX_REPEAT,
        schedules: tuple = SCHEDULES, seed: int = 42, row: str | None = None, carry: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, size,
    source_size, target, taken, laps, positions.

    Rows of a source stand in the order of md5(seed, doc_id); the source's token
    stream is read for ``target`` words, beginning again at its end. ``taken`` is
    what falls on the row, so taken sums to the target (rounded) in every source
    and only the row at the end of the last lap is taken in part. ``positions``
    has the training time of each lap that reads the row, in [0, 1]. Null sources
    are one source, the last; rows without words take nothing but are placed in
    every lap that passes them. Rows that repeat a doc_id are rows of their own.
    The order depends on rows alone, so reruns agree. row names a column with a
    number of its own for every row, which is carried along; the text then orders
    rows that agree in doc_id and number of words. carry names a column that goes
    along as ``_carried``, whole texts too: rows are then not written first, and docs
    is read twice and must give the same rows each time.
    """
    extra = [F.col(row).alias("_row"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text")] if row else []
    extra += [F.col(carry).alias("_carried")] if carry else []
    ties = ["_text", "_row"] if row else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), *extra)
    rows = rows.withColumn("ord", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows if carry else materialise(rows, "mix")
    n = rows.count()
    buckets = spread(n, 10_000)
    rows = rows.withColumn("bucket", (F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(2**32))).cast("long"))
    sums = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix_sums")
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    plan = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_repeat)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    plan = plan.withColumn("schedule", F.element_at(table, (F.col("rank") % len(schedules) + 1).cast("int")))
    small = starts.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.*", "source_size", "target", "schedule")
    if carry and sums.count() <= 500_000:  # a row for some 10,000 documents: whole rows are then dealt once, for the window
        small = F.broadcast(small)
    joined = (rows.alias("r").join(small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
              .select("r.*", "ahead", "source_size", "target", "schedule"))
    upto = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("ahead") + F.sum("size").over(upto)
    d = joined.withColumn("start", end - F.col("size")).withColumn("goal", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("full", full).withColumn("rest", F.col("goal") - F.col("full") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start"))).cast("long")
    laps = F.col("full") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)
    d = d.withColumn("taken", F.col("full") * F.col("size") + part).withColumn("laps", laps.cast("int"))
    lap_list = F.when(F.col("laps") > 0, F.sequence(F.lit(0), F.col("laps") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.transform(lap_list, lambda k: _position(
        F.least((k * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("goal"), F.lit(1.0)), F.col("schedule")))
    return d.select("doc_id", "source", "size", "source_size", "target", "taken", "laps", places.alias("positions"), *ties[1:], *(["_carried"] if carry else []))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mix as a training order: one row per document and lap (doc_id, source,
    lap, words, position), range-sorted by position, then doc_id and lap."""
    m = mix(docs, **options)
    lap = F.posexplode("positions").alias("lap", "position")
    words = F.when(F.col("lap") + 1 < F.col("laps"), F.col("size")).otherwise(F.col("taken") - F.col("size") * (F.col("laps") - 1))
    return (m.select("doc_id", "source", "size", "taken", "laps", lap)
            .select("doc_id", "source", "lap", words.alias("words"), "position").orderBy("position", "doc_id", "lap"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per document and lap, range-sorted by training
    position, with the columns of docs. A lap taken in part has the text's first
    words, one space apart, and n_chars (where docs has it) of that text. Every row
    keeps its own text, also where doc_id is null or repeated: rows go through the mix
    whole and are written with their places, once, before the laps are sorted. Input
    columns may have any names. docs is read twice and must give the same rows each time."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = (docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at"))
         .select("row", "at", *[F.col("row")[c].alias(c) for c in ("doc_id", "source", "text")]))
    whole = materialise(mix(d, row="at", carry="row", **options).where("laps > 0"), "mixed", "zstd")
    joined = whole.select(F.col("_carried").alias("row"), F.col("_row").alias("at"), F.col("doc_id").alias("id"), "size", "laps",
                          (F.col("taken") - F.col("size") * (F.col("laps") - 1)).alias("last"), F.posexplode("positions").alias("lap", "position"))
    text = F.col("row")["text"]
    part = (F.col("lap") == F.col("laps") - 1) & (F.col("last") < F.col("size"))
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " +"), lambda w: w != "")
    cut = F.when(part, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("last"), F.lit(0)).cast("int")), " ")).otherwise(text)
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": cut}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(part, F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    placed = joined.select(F.struct(*[v.alias(c) for c, v in own.items()]).alias("row"), "position", "id", "lap", "at")
    return placed.orderBy("position", "id", "lap", "at").select("row.*")
