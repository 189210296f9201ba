"""Scoring and record queries (build step 6) with DuckDB twins.

Roles (FIXTURES §3): labelled lineitem + arithmetic score as predictions;
orders as reviewed cases (status → reviewer decision, priority → reviewer /
comment presence); events as an audit log; embeddings as JSON requests.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import records as R
from ..operators import scoring as SC
from .catalog import register
from .inputs import LABELLED_SQL, labelled, table


def _scored(spark, sf_dir, threshold=0.5):
    lab = labelled(spark, sf_dir)
    return SC.score_cases(lab, SC.expression_scorer(F.col("score")), threshold, "case_key")


def _scored_sql(t="0.5"):
    return f"""sc AS (SELECT case_key, 'CASE-' || upper(substr(md5(case_key), 1, 8)) AS case_id,
        score AS probability, round_even(score * 100, 2) AS probability_pct,
        CASE WHEN score >= {t} THEN 'Malignant' ELSE 'Benign' END AS prediction,
        CASE WHEN score >= 0.75 THEN 'High' WHEN score >= {t} THEN 'Moderate' ELSE 'Low' END AS risk_level,
        CAST({t} AS DOUBLE) AS threshold FROM lab)"""


@register("score_cases", f"""
WITH {LABELLED_SQL}, {_scored_sql()} SELECT * FROM sc""")
def score_cases_q(spark, sf_dir):
    """J15+I1-I3+B10: probability → label, band, case id, percent."""
    return _scored(spark, sf_dir)


@register("risk_bands", f"""
WITH {LABELLED_SQL}, {_scored_sql('0.8')}
SELECT prediction, risk_level, count(*) AS cases FROM sc GROUP BY prediction, risk_level""")
def risk_bands_q(spark, sf_dir):
    """I1 order at threshold 0.8 > 0.75: High rows can be Benign."""
    return (_scored(spark, sf_dir, 0.8).groupBy("prediction", "risk_level")
            .agg(F.count(F.lit(1)).alias("cases")))


@register("case_records", f"""
WITH {LABELLED_SQL}, {_scored_sql()}
SELECT case_id AS Case_ID, prediction AS Predicted_Diagnosis, probability AS Malignant_Probability,
       threshold AS Threshold, risk_level AS Risk_Level FROM sc""")
def case_records_q(spark, sf_dir):
    """The stored prediction record per case (probability as a fraction)."""
    return R.prediction_records(_scored(spark, sf_dir)).drop("case_key")


@register("response_json", f"""
WITH {LABELLED_SQL}, {_scored_sql()}
SELECT case_id, to_json(struct_pack(case_id := case_id, prediction := prediction,
    malignant_probability := probability_pct, decision_threshold := threshold, risk_level := risk_level,
    top_factors := CAST([] AS STRUCT(feature VARCHAR, "value" DOUBLE, shap_value DOUBLE, direction VARCHAR)[]),
    prediction_file := case_id || '_prediction.csv',
    disclaimer := '{S.DISCLAIMER}'))::VARCHAR AS response FROM sc""")
def response_json_q(spark, sf_dir):
    """Nested JSON response per case (no factors requested)."""
    return SC.response_json(_scored(spark, sf_dir))


def _pct_sql(x):
    return f"printf('%.2f', round_even({x} * 100, 2)) || '%'"


@register("report_text", f"""
WITH {LABELLED_SQL}, {_scored_sql()}
SELECT case_id AS Case_ID,
  printf({S.REPORT_HEAD!r}, {S.REPORT_TITLE!r}, case_id, prediction, {_pct_sql('probability')}, risk_level,
         printf('%.2f', round_even(threshold, 2)))
  || CASE WHEN risk_level = 'High' THEN {S.REPORT_HIGH!r} WHEN risk_level = 'Moderate' THEN {S.REPORT_MODERATE!r}
          ELSE {S.REPORT_LOW!r} END
  || printf({S.REPORT_TAIL!r}, printf('%.2f', round_even(threshold, 2))) AS report
FROM sc""".replace("\\n", "\n"))
def report_text_q(spark, sf_dir):
    """The fixed text report of every prediction record."""
    return R.report_rows(R.prediction_records(_scored(spark, sf_dir)))


@register("audit_events", f"""
WITH lab AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS case_key,
                    round((l_quantity * 2 + l_discount * 1000 + l_tax * 500) / 260.0, 4) AS score,
                    l_shipdate FROM lineitem),
ev AS (SELECT case_key, 'CASE-' || upper(substr(md5(case_key), 1, 8)) AS case_id, score AS probability,
        CASE WHEN score >= 0.5 THEN 'Malignant' ELSE 'Benign' END AS prediction,
        CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Moderate' ELSE 'Low' END AS risk_level,
        CAST(0.5 AS DOUBLE) AS threshold, l_shipdate FROM lab)
SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS Timestamp, case_id AS Case_ID,
       'PREDICTION_CREATED' AS Event_Type,
       'Prediction=' || prediction || '; Probability=' || printf('%.4f', round_even(probability, 4))
       || '; Threshold=' || printf('%.2f', round_even(threshold, 2)) || '; Risk=' || risk_level AS Details
FROM ev""")
def audit_events_q(spark, sf_dir):
    """One PREDICTION_CREATED audit row per scored case, stamped
    with the ship date, exported with ISO-seconds text."""
    from .inputs import score_expr
    li = table(spark, sf_dir, "lineitem")
    lab = li.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
                    .alias("case_key"), score_expr().alias("score"), "l_shipdate")
    sc = SC.score_cases(lab, SC.expression_scorer(F.col("score")), 0.5, "case_key",
                        keep=["l_shipdate"])
    return R.audit_export(R.prediction_events(sc, F.col("l_shipdate")))


def _audit_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("ts").alias("Timestamp"), S.case_id(F.col("user_id")).alias("Case_ID"),
                     F.upper("event_type").alias("Event_Type"), F.col("props").alias("Details"),
                     "event_id")


_AUDIT_SQL = """au AS (SELECT ts AS Timestamp, 'CASE-' || upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS Case_ID,
    upper(event_type) AS Event_Type, props AS Details, event_id FROM events)"""


@register("audit_history", f"""
WITH {_AUDIT_SQL}
SELECT * FROM au WHERE Case_ID = 'CASE-' || upper(substr(md5('8'), 1, 8))""")
def audit_history_q(spark, sf_dir):
    """Audit rows of one case (events of user 8 as its audit log)."""
    one = "CASE-" + hashlib.md5(b"8").hexdigest()[:8].upper()  # same rule as S.case_id
    return R.audit_history(_audit_log(spark, sf_dir), one)


@register("latest_prediction", """
SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id""")
def latest_prediction_q(spark, sf_dir):
    """Newest event per user (max_by on (ts, event_id))."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", "event_id")
    return R.latest_record(ev, ["user_id"], "ts", tie="event_id")


def _orders_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.select("o_orderkey", "o_orderdate",
                 F.round(F.col("o_totalprice") / 600000.0, 4).alias("score"))
    sc = SC.score_cases(d, SC.expression_scorer(F.col("score")), 0.5, "o_orderkey",
                        keep=["o_orderdate"])
    return sc


def _raw_feedback(spark, sf_dir):
    """Reviewer input derived from orders: status → decision text with stray
    spaces/case; priority 5 → blank reviewer; priority 4 → an invalid
    decision; priority 1 → a comment, else blank."""
    o = table(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    dec = (F.when(pr.startswith("4"), F.lit("unknown"))
           .when(F.col("o_orderstatus") == "F", F.lit(" malignant"))
           .when(F.col("o_orderstatus") == "O", F.lit("BENIGN "))
           .otherwise(F.lit("uncertain")))
    return o.select(
        F.col("o_orderkey").cast("string").alias("case_key"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("Timestamp"),
        S.case_id(F.col("o_orderkey")).alias("Case_ID"),
        F.when(pr.startswith("5"), F.lit("  ")).otherwise(
            F.concat(F.lit("Reviewer "), F.col("o_custkey").cast("string"))).alias("reviewer"),
        dec.alias("decision"),
        F.when(pr.startswith("1"), F.lit("urgent review")).otherwise(F.lit("   ")).alias("comment"))


_ORDERS_SQL = """
osc AS (SELECT o_orderkey, o_orderdate, round(o_totalprice / 600000.0, 4) AS score FROM orders),
orec AS (SELECT o_orderkey, 'CASE-' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS Case_ID, o_orderdate,
   CASE WHEN score >= 0.5 THEN 'Malignant' ELSE 'Benign' END AS Predicted_Diagnosis,
   score AS Malignant_Probability, 0.5 AS Threshold,
   CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Moderate' ELSE 'Low' END AS Risk_Level FROM osc),
raw AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS Timestamp,
   'CASE-' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS Case_ID,
   CASE WHEN o_orderpriority LIKE '5%' THEN '  ' ELSE 'Reviewer ' || CAST(o_custkey AS VARCHAR) END AS reviewer,
   CASE WHEN o_orderpriority LIKE '4%' THEN 'unknown' WHEN o_orderstatus = 'F' THEN ' malignant'
        WHEN o_orderstatus = 'O' THEN 'BENIGN ' ELSE 'uncertain' END AS decision,
   CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent review' ELSE '   ' END AS comment FROM orders),
nrm AS (SELECT *, trim(reviewer) AS rev, upper(substr(trim(decision), 1, 1)) || lower(substr(trim(decision), 2)) AS dec FROM raw),
chk AS (SELECT *, CASE WHEN length(rev) = 0 THEN 'Reviewer name cannot be empty.'
                      WHEN dec NOT IN ('Benign', 'Malignant', 'Uncertain') THEN 'Please enter Benign, Malignant, or Uncertain.'
                 END AS reason FROM nrm),
fb AS (SELECT o_orderkey, Timestamp, Case_ID, rev AS Doctor_Name, dec AS Final_Clinical_Decision,
       coalesce(nullif(trim(comment), ''), 'No additional comments provided.') AS Clinical_Comments
       FROM chk WHERE reason IS NULL),
fj AS (SELECT fb.Timestamp, fb.Case_ID, fb.Doctor_Name, orec.Predicted_Diagnosis AS Model_Prediction,
       orec.Malignant_Probability, orec.Risk_Level, fb.Final_Clinical_Decision,
       CASE WHEN Final_Clinical_Decision = 'Uncertain' THEN 'Not Applicable'
            WHEN Final_Clinical_Decision = orec.Predicted_Diagnosis THEN 'Agree' ELSE 'Disagree' END
         AS Model_Clinical_Agreement, fb.Clinical_Comments
       FROM fb JOIN orec USING (o_orderkey))"""


@register("feedback_agreement", f"""
WITH {_ORDERS_SQL} SELECT * FROM fj""")
def feedback_agreement_q(spark, sf_dir):
    """Validated reviewer feedback joined to its prediction,
    with the agreement label."""
    records = R.prediction_records(_orders_records(spark, sf_dir))
    valid, _ = R.validate_feedback(_raw_feedback(spark, sf_dir))
    return R.join_feedback(records, valid)


@register("feedback_rejects", f"""
WITH {_ORDERS_SQL} SELECT Timestamp, Case_ID, reviewer, decision, comment, reason FROM chk WHERE reason IS NOT NULL""")
def feedback_rejects_q(spark, sf_dir):
    """Reviewer rows rejected with their reason."""
    _, rejects = R.validate_feedback(_raw_feedback(spark, sf_dir))
    return rejects.drop("case_key")


@register("case_timeline", f"""
WITH {_ORDERS_SQL},
pe AS (SELECT o_orderdate AS Timestamp, Case_ID, 'PREDICTION_CREATED' AS Event_Type,
   'Prediction=' || Predicted_Diagnosis || '; Probability=' || printf('%.4f', round_even(Malignant_Probability, 4))
   || '; Threshold=' || printf('%.2f', round_even(Threshold, 2)) || '; Risk=' || Risk_Level AS Details FROM orec),
re AS (SELECT o_orderdate + INTERVAL 1 HOUR AS Timestamp, Case_ID, 'REPORT_GENERATED' AS Event_Type,
   'Clinical report created; Prediction=' || Predicted_Diagnosis || '; Risk=' || Risk_Level AS Details FROM orec),
fe AS (SELECT Timestamp, Case_ID, 'DOCTOR_FEEDBACK_RECEIVED' AS Event_Type,
   'Reviewer=' || Doctor_Name || '; FinalDecision=' || Final_Clinical_Decision || '; Agreement=' || Model_Clinical_Agreement AS Details FROM fj)
SELECT strftime(Timestamp, '%Y-%m-%dT%H:%M:%S') AS Timestamp, Case_ID, Event_Type, Details
FROM (SELECT * FROM pe UNION ALL SELECT * FROM re UNION ALL SELECT * FROM fe)""")
def case_timeline_q(spark, sf_dir):
    """Prediction, report and feedback events of every order-case."""
    sc = _orders_records(spark, sf_dir)
    records = R.prediction_records(sc).join(
        sc.select("case_key", "o_orderdate"), "case_key")
    valid, _ = R.validate_feedback(_raw_feedback(spark, sf_dir))
    fb = R.join_feedback(records.drop("o_orderdate"), valid)
    pe = R.prediction_events(sc, F.col("o_orderdate"))
    re_ = R.report_events(records, F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"))
    return R.audit_export(R.case_timeline(pe, re_, R.feedback_events(fb)))


#: Values of an embedding, the arity of a request.
N_VALUES = 64


def _requests(spark, sf_dir):
    """JSON bodies from embeddings: all 64 values; class 3 sends 63 and class 7 sends a text token first (planted defects)."""
    e = table(spark, sf_dir, "embeddings")
    nums = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    nums = F.when(F.col("label") == 3, F.slice(nums, 1, N_VALUES - 1)).otherwise(nums)
    body = F.concat(F.lit('{"features": ['),
                    F.when(F.col("label") == 7, F.lit('"abc", ')).otherwise(F.lit("")),
                    F.array_join(nums, ", "), F.lit("]}"))
    return e.select("vec_id", body.alias("body"))


_REQ_SQL = """
rq AS (SELECT vec_id, '{"features": [' || CASE WHEN label = 7 THEN '"abc", ' ELSE '' END
   || array_to_string(CASE WHEN label = 3 THEN embedding[1:63] ELSE embedding END, ', ') || ']}' AS body FROM embeddings),
rp AS (SELECT vec_id, body, json_array_length(body, '$.features') AS n,
   list_bool_and(list_transform(json_extract(body, '$.features[*]'), lambda x: json_type(x) IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) AS numeric FROM rq)"""


@register("request_rejects", f"""
WITH {_REQ_SQL}
SELECT vec_id, CASE WHEN NOT numeric THEN 'Request body is not valid JSON with a features list.'
                    ELSE 'Exactly 64 input features are required.' END AS reason
FROM rp WHERE NOT numeric OR n <> 64""")
def request_rejects_q(spark, sf_dir):
    """JSON requests rejected for arity or non-numeric values."""
    _, rej = R.parse_feature_requests(_requests(spark, sf_dir), "body", N_VALUES, keep=["vec_id"])
    return rej.select("vec_id", "reason")


@register("request_valid", f"""
WITH {_REQ_SQL}
SELECT vec_id, CAST(n AS BIGINT) AS n_features FROM rp WHERE numeric AND n = 64""")
def request_valid_q(spark, sf_dir):
    """Accepted requests (array of 64 doubles)."""
    ok, _ = R.parse_feature_requests(_requests(spark, sf_dir), "body", N_VALUES, keep=["vec_id"])
    return ok.select("vec_id", F.size("features").cast("long").alias("n_features"))


def _uploads(spark, sf_dir):
    """One CSV upload per embedding, in eight kinds by vec_id: with a quoted header (its
    names hold commas), without one, quoted values behind a blank line, 63 values, a bad
    second line, another suffix, a header alone, nothing but blanks."""
    e = table(spark, sf_dir, "embeddings").withColumn("kind", F.col("vec_id") % 8)
    nums = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    header = F.lit(",".join(f'"value, {i}"' for i in range(N_VALUES)))
    data, quoted = F.array_join(nums, ","), F.concat(F.lit('"'), F.array_join(nums, '" , "'), F.lit('"'))
    short, bad = F.array_join(F.slice(nums, 1, N_VALUES - 1), ","), F.concat(F.lit("abc,"), F.array_join(F.slice(nums, 2, N_VALUES), ","))
    kinds = [F.array(header, data), F.array(data), F.array(header, F.lit(" "), quoted), F.array(short), F.array(data, bad),
             F.array(data), F.array(header), F.array(F.lit("  "), F.lit(""))]
    lines = F.element_at(F.array(*kinds), (F.col("kind") + 1).cast("int"))
    name = F.concat(F.lit("upload_"), F.col("vec_id").cast("string"), F.when(F.col("kind") == 5, ".txt").otherwise(".csv"))
    return (e.select(name.alias("file"), F.posexplode(lines).alias("line_no", "line"))
            .withColumn("line_no", F.col("line_no").cast("long")))


@register("csv_valid", """
SELECT 'upload_' || vec_id || '.csv' AS file, CAST(CASE vec_id % 8 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS line_no,
       CAST(len(embedding) AS BIGINT) AS n_features, unnest(embedding)::DOUBLE AS value, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos
FROM embeddings WHERE vec_id % 8 IN (0, 1, 2, 4)""")
def csv_valid_q(spark, sf_dir):
    """Every value of the accepted upload lines."""
    ok, _ = R.validate_feature_lines(_uploads(spark, sf_dir), N_VALUES)
    return (ok.select("file", "line_no", F.size("features").cast("long").alias("n_features"), F.posexplode("features").alias("pos", "value"))
            .withColumn("pos", F.col("pos").cast("long")))


@register("csv_rejects", """
SELECT 'upload_' || vec_id || CASE WHEN vec_id % 8 = 5 THEN '.txt' ELSE '.csv' END AS file,
       CAST(CASE vec_id % 8 WHEN 3 THEN 0 WHEN 4 THEN 1 END AS BIGINT) AS line_no,
       CASE vec_id % 8 WHEN 3 THEN 'CSV must contain exactly 64 feature values. Found 63.'
                       WHEN 4 THEN 'CSV contains one or more non-numeric feature values.'
                       WHEN 5 THEN 'Please select a CSV file.' WHEN 6 THEN 'CSV contains a header but no data row.'
                       ELSE 'CSV file is empty.' END AS reason
FROM embeddings WHERE vec_id % 8 IN (3, 4, 5, 6, 7)""")
def csv_rejects_q(spark, sf_dir):
    """Upload lines and files rejected with their reason."""
    _, rejects = R.validate_feature_lines(_uploads(spark, sf_dir), N_VALUES)
    return rejects


@register("display_fields", f"""
WITH {LABELLED_SQL}, {_scored_sql()}
SELECT case_id, CASE WHEN lower(risk_level) = 'high' THEN 'HIGH RISK'
                     WHEN lower(risk_level) = 'moderate' THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS badge,
       least(greatest(probability_pct, 0.0), 100.0) AS bar_pct,
       {_pct_sql('probability')} AS percent_text FROM sc""")
def display_fields_q(spark, sf_dir):
    """Badge, clamped bar width and percent text per case."""
    sc = _scored(spark, sf_dir)
    return sc.select("case_id", S.risk_badge("risk_level").alias("badge"),
                     S.clamp_pct("probability_pct").alias("bar_pct"),
                     S.percent_text("probability").alias("percent_text"))


@register("feature_labels", """
SELECT p_partkey,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label,
  replace(replace(lower(p_type), ' ', '_'), '-', '') AS slug FROM part""")
def feature_labels_q(spark, sf_dir):
    """Display label (first letter of each word upper-cased, rest
    kept) and file slug of part names/types."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.feature_label("p_name").alias("label"),
                    S.slug("p_type").alias("slug"))


@register("completeness", """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN '' ELSE 'v' END) AS arr FROM embeddings),
n AS (SELECT vec_id, len(list_filter(arr, lambda x: trim(x) <> '')) AS filled FROM c)
SELECT vec_id, CAST(filled AS BIGINT) AS filled,
  CASE WHEN filled = 64 THEN 'Tumor measurements ready for analysis'
       WHEN filled > 0 THEN 'Tumor measurements partially loaded'
       ELSE 'Waiting for tumor measurements' END AS status FROM n""")
def completeness_q(spark, sf_dir):
    """Non-blank count of a 64-field form and its status text (negative
    embedding values stand for blank fields)."""
    e = table(spark, sf_dir, "embeddings")
    arr = F.transform("embedding",
                      lambda x: F.when(x < 0, F.lit("")).otherwise(F.lit("v")))
    d = e.select("vec_id", arr.alias("arr"))
    return d.select("vec_id", S.completeness_count("arr").cast("long").alias("filled"),
                    S.completeness_status("arr", N_VALUES).alias("status"))
