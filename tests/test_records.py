"""Request / upload validation, feedback rules, latest record."""

import datetime as dt

from pyspark.sql import functions as F

from riskframe.operators import records as R


def test_json_requests(spark):
    good = "[" + ", ".join(["1.5"] * 30) + "]"
    d = spark.createDataFrame([(1, '{"features": ' + good + "}"),
                               (2, '{"features": [1, 2]}'),
                               (3, '{"features": ["a"' + ", 1" * 29 + "]}"),
                               (4, "not json")], "id int, body string")
    valid, rej = R.parse_feature_requests(d, "body", 30, keep=["id"])
    assert [r["id"] for r in valid.collect()] == [1]
    reasons = {r["id"]: r["reason"] for r in rej.collect()}
    assert reasons[2] == R.MSG_ARITY.format(n=30)
    assert reasons[3] == R.MSG_NOT_JSON and reasons[4] == R.MSG_NOT_JSON


def _lines(spark, files):
    rows = [(f, i, line) for f, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def test_csv_uploads(spark):
    nums = ",".join(str(i + 0.5) for i in range(30))
    header = ",".join(f'"f{i}"' for i in range(30))
    files = {"ok.csv": header + "\n" + nums + "\n\n" + nums,
             "blank.csv": "  \n ",
             "header_only.csv": header,
             "csv_31.csv": nums + ",1",
             "csv_text.csv": nums + "\n" + nums.replace("0.5", "abc", 1),
             "data.txt": nums}
    valid, rej = R.validate_feature_lines(_lines(spark, files), 30)
    assert sorted((r["file"], r["line_no"]) for r in valid.collect()) == [
        ("csv_text.csv", 0), ("ok.csv", 1), ("ok.csv", 3)]
    got = {(r["file"], r["reason"]) for r in rej.collect()}
    assert ("blank.csv", R.MSG_EMPTY) in got
    assert ("header_only.csv", R.MSG_HEADER_ONLY) in got
    assert ("csv_31.csv", R.MSG_CSV_ARITY.format(n=30, found=31)) in got
    assert ("data.txt", R.MSG_NOT_CSV) in got
    # the first line of csv_text is data (all numeric), the second is rejected
    assert ("csv_text.csv", R.MSG_NON_NUMERIC) in got


def test_feedback_validation(spark):
    ts = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([
        (ts, "C1", " Dr A ", " benign ", ""), (ts, "C2", "  ", "Benign", "x"),
        (ts, "C3", "Dr B", "maybe", "x")],
        "Timestamp timestamp, Case_ID string, reviewer string, decision string, comment string")
    valid, rej = R.validate_feedback(raw)
    v = valid.collect()
    assert len(v) == 1 and v[0]["Doctor_Name"] == "Dr A" and v[0]["Final_Clinical_Decision"] == "Benign"
    assert v[0]["Clinical_Comments"] == "No additional comments provided."
    assert {r["Case_ID"]: r["reason"] for r in rej.collect()} == {
        "C2": R.MSG_BLANK_REVIEWER, "C3": R.MSG_BAD_DECISION}


def test_latest_record(spark):
    d = spark.createDataFrame([(1, 5, "a", 1), (1, 9, "b", 2), (1, 9, "c", 3), (2, 1, "d", 4)],
                              "k int, ts int, v string, tie int")
    got = {r["k"]: r["v"] for r in R.latest_record(d, ["k"], "ts", tie="tie").collect()}
    assert got == {1: "c", 2: "d"}


def test_feedback_joins_on_the_full_key(spark):
    """Two cases that show the same Case_ID stay apart."""
    rec = spark.createDataFrame([("k1", "CASE-1", "Benign", 0.1, 0.5, "Low"), ("k2", "CASE-1", "Malignant", 0.9, 0.5, "High")],
                                "case_key string, Case_ID string, Predicted_Diagnosis string, Malignant_Probability double, Threshold double, Risk_Level string")
    raw = spark.createDataFrame([("k2", "2024-01-01", "CASE-1", "Dr", "malignant", "")],
                                "case_key string, Timestamp string, Case_ID string, reviewer string, decision string, comment string")
    got = R.join_feedback(rec, R.validate_feedback(raw)[0]).collect()
    assert [(r.Model_Prediction, r.Model_Clinical_Agreement) for r in got] == [("Malignant", "Agree")]


def test_csv_hex_and_quotes(spark):
    valid, rejects = R.validate_feature_lines(_lines(spark, {"a.csv": '"3","4",0x1A\n"1,5",2,3'}), 3)
    assert [r.features for r in valid.collect()] == [[3.0, 4.0, 26.0]]
    assert [r.reason for r in rejects.collect()] == [R.MSG_NON_NUMERIC]


def test_csv_long_lines(spark):
    many = ",".join(f'"{i}"' for i in range(100_000))
    files = {"many.csv": many, "digits.csv": "1" * 1_000_000 + "x\n1,2,3", "open.csv": '1,2,3\n"a,b,1,2', "null.csv": "1,2,3"}
    lines = _lines(spark, files).union(spark.createDataFrame([("null.csv", 1, None)], "file string, line_no long, line string"))
    valid, rejects = R.validate_feature_lines(lines, 3)
    assert sorted((r.file, r.line_no) for r in valid.collect()) == [("digits.csv", 1), ("null.csv", 0), ("open.csv", 0)]
    assert sorted((r.file, r.line_no, r.reason) for r in rejects.collect()) == [
        ("many.csv", 0, R.MSG_CSV_ARITY.format(n=3, found=100_000)), ("open.csv", 1, R.MSG_CSV_ARITY.format(n=3, found=4))]


def test_csv_fields_like_a_pattern(spark):
    import random
    import re
    r = random.Random(5)
    texts = ["".join(r.choice('ab",, ') for _ in range(12)) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "line string").select("line", R.csv_fields(F.col("line")).alias("f"))
    for row in d.collect():
        cuts = re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', row.line)
        assert row.f == [re.sub(r'^"(.*)"$', r"\1", x.strip(" ")).strip(" ") for x in cuts], row.line
