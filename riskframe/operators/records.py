"""Records: predictions, reports, reviewer feedback, audit events, case
timelines, and validation of incoming requests (SURVEY A5-A10, C1, C4-C7,
D2, D6, I6-I12).

Validation never raises on bad rows: each validator returns ``(valid,
rejects)`` where rejects carry the reason, so a batch or a stream keeps going.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Reject messages of request and upload validation.
MSG_ARITY = "Exactly {n} input features are required."
MSG_NOT_JSON = "Request body is not valid JSON with a features list."
MSG_NOT_CSV = "Please select a CSV file."
MSG_EMPTY = "CSV file is empty."
MSG_HEADER_ONLY = "CSV contains a header but no data row."
MSG_CSV_ARITY = "CSV must contain exactly {n} feature values. Found {found}."
MSG_NON_NUMERIC = "CSV contains one or more non-numeric feature values."
MSG_BLANK_REVIEWER = "Reviewer name cannot be empty."
MSG_BAD_DECISION = "Please enter Benign, Malignant, or Uncertain."

# A JavaScript-style numeric literal (what the upload check accepts).
NUMERIC_RE = r"^[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|Infinity)$"


def _number(x):
    """Value of a NUMERIC_RE string: hexadecimal digits too, and never an error."""
    digits = F.conv(F.substring(x, 3, 64), 16, 10).try_cast("double")
    return F.when(x.rlike(r"^0[xX]"), digits).otherwise(x.try_cast("double"))


# A6 ------------------------------------------------------------------------
def prediction_records(scored: DataFrame) -> DataFrame:
    """The stored prediction record (probability as a fraction); carries the full
    case_key where scored has one. Case_ID shows 32 bits of it and is no key."""
    key = [c for c in ("case_key",) if c in scored.columns]
    return scored.select(
        *key,
        F.col("case_id").alias("Case_ID"), F.col("prediction").alias("Predicted_Diagnosis"),
        F.col("probability").alias("Malignant_Probability"),
        F.col("threshold").alias("Threshold"), F.col("risk_level").alias("Risk_Level"))


# I12 / A8 ------------------------------------------------------------------
def report_rows(records: DataFrame, title: str = S.REPORT_TITLE) -> DataFrame:
    """One text report per prediction record."""
    return records.select("Case_ID", S.report_text(
        "Case_ID", "Predicted_Diagnosis", "Malignant_Probability", "Risk_Level",
        F.col("Threshold"), title).alias("report"))


# I9 / I10 / K2 -------------------------------------------------------------
def prediction_events(scored: DataFrame, ts: Column | None = None) -> DataFrame:
    return scored.select(
        (ts if ts is not None else F.current_timestamp()).alias("Timestamp"),
        F.col("case_id").alias("Case_ID"), F.lit(S.EVENT_PREDICTION).alias("Event_Type"),
        S.prediction_details("prediction", "probability", F.col("threshold"), "risk_level")
        .alias("Details"))


def report_events(records: DataFrame, ts: Column | None = None) -> DataFrame:
    return records.select(
        (ts if ts is not None else F.current_timestamp()).alias("Timestamp"),
        F.col("Case_ID"), F.lit(S.EVENT_REPORT).alias("Event_Type"),
        S.report_details("Predicted_Diagnosis", "Risk_Level").alias("Details"))


def feedback_events(feedback: DataFrame) -> DataFrame:
    return feedback.select(
        "Timestamp", "Case_ID", F.lit(S.EVENT_FEEDBACK).alias("Event_Type"),
        S.feedback_details("Doctor_Name", "Final_Clinical_Decision",
                           "Model_Clinical_Agreement").alias("Details"))


def audit_export(events: DataFrame) -> DataFrame:
    """Audit rows with the ISO-seconds (UTC) text timestamp of the CSV export."""
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
    return events.select(S.iso_seconds("Timestamp", tz).alias("Timestamp"), "Case_ID",
                         "Event_Type", "Details")


# C1 ------------------------------------------------------------------------
def audit_history(audit: DataFrame, case_id: str | None = None) -> DataFrame:
    """All events, or those of one case (a pushed-down equality filter)."""
    return audit if case_id is None else audit.where(F.col("Case_ID") == F.lit(case_id))


# A7 ------------------------------------------------------------------------
def latest_record(df: DataFrame, by: Sequence[str], ts: str, tie: str | None = None) -> DataFrame:
    """Newest row per key: ``max_by(struct(row), (ts, tie))`` — one
    aggregate with map-side partial states, no window sort."""
    others = [c for c in df.columns if c not in by]
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    agg = df.groupBy(*by).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return agg.select(*by, *[F.col("_r")[c].alias(c) for c in others])


# C4 / C7 / I6-I8 / D2 ------------------------------------------------------
def validate_feedback(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw reviewer input (Case_ID, Timestamp, reviewer, decision, comment) →
    (normalised rows, rejects). Reviewer must be non-blank after trim; the
    decision is trimmed and title-cased and must be one of the three names;
    a blank comment becomes the default text. A case_key is carried along."""
    key = [c for c in ("case_key",) if c in raw.columns]
    d = raw.select("*", F.trim("reviewer").alias("_rev"),
                   S.normalise_decision("decision").alias("_dec"))
    reason = (F.when(F.coalesce(F.length("_rev"), F.lit(0)) == 0, F.lit(MSG_BLANK_REVIEWER))
              .when(~F.coalesce(F.col("_dec").isin(*S.DECISIONS), F.lit(False)),
                    F.lit(MSG_BAD_DECISION)))
    d = d.withColumn("reason", reason)
    valid = d.where(F.col("reason").isNull()).select(
        *key, "Timestamp", "Case_ID", F.col("_rev").alias("Doctor_Name"),
        F.col("_dec").alias("Final_Clinical_Decision"),
        S.default_comment("comment").alias("Clinical_Comments"))
    rejects = d.where(F.col("reason").isNotNull()).select(*raw.columns, "reason")
    return valid, rejects


def join_feedback(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback rows carry over the prediction fields of their case and get
    the agreement label. Joined on the full case_key where both sides have it, as
    Case_ID can stand for several cases; else on Case_ID."""
    key = "case_key" if "case_key" in records.columns and "case_key" in feedback.columns else "Case_ID"
    j = feedback.join(records.select(key, "Predicted_Diagnosis", "Malignant_Probability", "Risk_Level"), key, "inner")
    return j.select(
        "Timestamp", "Case_ID", "Doctor_Name",
        F.col("Predicted_Diagnosis").alias("Model_Prediction"),
        "Malignant_Probability", "Risk_Level", "Final_Clinical_Decision",
        S.agreement("Final_Clinical_Decision", "Predicted_Diagnosis").alias("Model_Clinical_Agreement"),
        "Clinical_Comments")


# D6 ------------------------------------------------------------------------
def case_timeline(*event_tables: DataFrame) -> DataFrame:
    """Union of event tables ordered by (case, time, type). A range-partitioned
    sort: one busy case is split across tasks by its timestamps instead of
    landing in a single per-case window."""
    u = event_tables[0]
    for e in event_tables[1:]:
        u = u.unionByName(e)
    return u.orderBy("Case_ID", "Timestamp", "Event_Type", "Details")


# A10 / C5 ------------------------------------------------------------------
def parse_feature_requests(df: DataFrame, json_col: str, n: int = 30,
                           keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON bodies ``{"features": [...]}`` → (valid rows with the array,
    rejects with reason). A body that does not parse, or whose list has a
    non-number, is 'not valid JSON'; a wrong length gets the arity message."""
    parsed = F.from_json(F.col(json_col), "features array<double>",
                         {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    d = df.select(*keep, json_col, parsed["features"].alias("features"))
    bad = F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x))
    reason = (F.when(bad, F.lit(MSG_NOT_JSON))
              .when(F.size("features") != n, F.lit(MSG_ARITY.format(n=n))))
    d = d.withColumn("reason", reason)
    valid = d.where(F.col("reason").isNull()).drop("reason", json_col)
    rejects = d.where(F.col("reason").isNotNull()).select(*keep, json_col, "reason")
    return valid, rejects


# A9 ------------------------------------------------------------------------
def csv_fields(line):
    """Fields of a line: commas inside double quotes do not cut, a quoted field loses
    its quotes. A line is cut at its quotes, commas outside them become line breaks
    (which a line cannot hold), and these cut the fields: linear in the line, at any
    number of fields. With a quote that is never closed, the quotes count from the end."""
    from_end = F.transform(F.reverse(F.split(line, '"')),
                           lambda part, quotes: F.when(quotes % 2 == 0, F.translate(part, ",", "\n")).otherwise(part))
    return F.transform(F.split(F.array_join(F.reverse(from_end), '"'), "\n"),
                       lambda x: F.trim(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1")))


def validate_feature_lines(lines: DataFrame, n: int = 30, file_col: str = "file",
                           line_col: str = "line", no_col: str = "line_no"
                           ) -> tuple[DataFrame, DataFrame]:
    """Uploaded CSV text, one row per (file, line_no, line) → (valid data
    rows with a ``features`` array, rejects with reason).

    Rules: the file must end in .csv; blank and null lines are skipped; a file with no
    non-blank line is empty; line 1 is a header iff any of its fields is not
    a number; a header-only file is rejected; every data line (all of them,
    not just the first) must have exactly n fields, each a number. Fields are
    trimmed; a blank field is not a number.

    The facts of a file (lines, first line, header or not) come from one aggregate
    with fixed-width states, joined back once."""
    text = F.coalesce(F.length(F.trim(F.col(line_col))) > 0, F.lit(False))
    d = lines.select(file_col, no_col, text.alias("_text"), csv_fields(F.col(line_col)).alias("_f"))
    d = d.withColumn("_num", F.col("_text") & F.forall("_f", lambda x: x.rlike(NUMERIC_RE)))
    # the least line number with the line's kind as its last bit
    first = F.min(F.when(F.col("_text"), F.col(no_col).cast("long") * 2 + F.col("_num").cast("long")))
    facts = d.groupBy(file_col).agg(F.count_if("_text").alias("_lines"), first.alias("_head"))
    header = F.coalesce(F.col("_head") % 2 == 0, F.lit(False))
    file_reason = (F.when(~F.lower(F.col(file_col)).endswith(".csv"), F.lit(MSG_NOT_CSV))
                   .when(F.col("_lines") == 0, F.lit(MSG_EMPTY))
                   .when(header & (F.col("_lines") < 2), F.lit(MSG_HEADER_ONLY)))
    facts = facts.select(file_col, file_reason.alias("_file_reason"), F.when(header, F.floor(F.col("_head") / 2)).alias("_header_no"))
    ok = facts.where("_file_reason IS NULL").select(file_col, "_header_no")
    data = d.where("_text").join(ok, file_col).where(~F.col(no_col).eqNullSafe(F.col("_header_no")))
    size = F.size("_f")
    reason = F.coalesce(
        F.when(size != n, F.format_string(MSG_CSV_ARITY.replace("{n}", str(n))
                                          .replace("{found}", "%d"), size)),
        F.when(~F.col("_num"), F.lit(MSG_NON_NUMERIC)))
    data = data.withColumn("reason", reason)
    valid = data.where(F.col("reason").isNull()).select(
        file_col, no_col, F.transform("_f", _number).alias("features"))
    line_rejects = data.where(F.col("reason").isNotNull()).select(file_col, no_col, "reason")
    file_rejects = facts.where("_file_reason IS NOT NULL").select(
        file_col, F.lit(None).cast("long").alias(no_col), F.col("_file_reason").alias("reason"))
    return valid, line_rejects.unionByName(file_rejects)


def ingest_feature_csv(spark, path: str, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """A9 over files: each uploaded file is read whole (``wholetext``; uploads
    are single small files) so line numbers are exact, then split into lines
    and validated by ``validate_feature_lines``."""
    raw = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), "value")
    lines = raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return validate_feature_lines(lines.withColumn("line_no", F.col("line_no").cast("long")), n)
