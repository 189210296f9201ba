"""Split, fold, shuffle and sample queries (build step 3) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import sampling as SM
from .catalog import register
from .inputs import FEATURES, LABELLED_SQL, labelled, table
from .q_metrics import _CONF_SQL, _METRICS_SQL


def _quota_sql(src: str, frac: float, name: str = "q") -> str:
    f = repr(float(frac))
    return f"""
{name}c AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
{name}c2 AS (SELECT label, n_c, sum(n_c) OVER () AS n FROM {name}c),
{name}c3 AS (SELECT *, CAST(ceil(CAST({f} AS DOUBLE) * n) AS BIGINT) AS n_test FROM {name}c2),
{name}c4 AS (SELECT *, n - n_test AS n_train, n_c / n * (n - n_test) AS cont FROM {name}c3),
{name}c5 AS (SELECT *, CAST(floor(cont) AS BIGINT) AS fl FROM {name}c4),
{name}c6 AS (SELECT *, n_train - sum(fl) OVER () AS need, cont - fl AS rem FROM {name}c5),
{name} AS (SELECT label, n_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= need
                           THEN 1 ELSE 0 END AS train_quota FROM {name}c6)"""


def _holdout_sql(src: str, frac: float, seed: str, out: str, names=("train", "test"),
                 name: str = "q") -> str:
    return f"""{_quota_sql(src, frac, name)},
{out} AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.label
            ORDER BY md5(concat_ws('|', '{seed}', s.case_key)), s.case_key) <= {name}.n_c - {name}.train_quota
          THEN '{names[1]}' ELSE '{names[0]}' END AS split
     FROM {src} s JOIN {name} ON s.label = {name}.label)"""


_KEYED = "k AS (SELECT case_key, label FROM lab)"


@register("stratified_holdout", f"""
WITH {LABELLED_SQL}, {_KEYED}, {_holdout_sql('k', 0.2, '42', 'h')}
SELECT case_key, label, split FROM h""")
def stratified_holdout_q(spark, sf_dir):
    """80/20 stratified split of labelled lineitem, md5 order, seed 42."""
    lab = labelled(spark, sf_dir).select("case_key", "label")
    return SM.stratified_holdout(lab, "label", 0.2, "case_key", 42)


@register("split_report", f"""
WITH {LABELLED_SQL}, {_KEYED}, {_holdout_sql('k', 0.2, '42', 'h')}
SELECT split, count(*) AS records, CAST(count_if(label = 1) AS BIGINT) AS positives,
       CAST(count_if(label = 0) AS BIGINT) AS negatives FROM h GROUP BY split""")
def split_report_q(spark, sf_dir):
    """Records, positives, negatives per split of S1."""
    lab = labelled(spark, sf_dir).select("case_key", "label")
    return M.split_report(SM.stratified_holdout(lab, "label", 0.2, "case_key", 42))


@register("train_validation_test", f"""
WITH {LABELLED_SQL}, {_KEYED}, {_holdout_sql('k', 0.2, '42', 'h1', ('rest', 'test'))},
r AS (SELECT case_key, label FROM h1 WHERE split = 'rest'),
{_holdout_sql('r', 0.2, '42/validation', 'h2', ('train', 'validation'), name='q2')}
SELECT case_key, label, split FROM h2
UNION ALL SELECT case_key, label, split FROM h1 WHERE split = 'test'""")
def train_validation_test_q(spark, sf_dir):
    """Nested split — test first, then validation from the rest."""
    lab = labelled(spark, sf_dir).select("case_key", "label")
    return SM.train_validation_test(lab, "label", 0.2, 0.2, "case_key", 42)


_KFOLD_SQL = """f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label
        ORDER BY md5(concat_ws('|', '42', case_key)), case_key) - 1) % 5 AS BIGINT) AS fold FROM lab)"""


@register("stratified_kfold", f"""
WITH {LABELLED_SQL}, {_KFOLD_SQL}
SELECT case_key, label, fold FROM f""")
def stratified_kfold_q(spark, sf_dir):
    """S3: 5 shuffled stratified folds (rank within class mod 5)."""
    lab = labelled(spark, sf_dir).select("case_key", "label")
    return SM.stratified_kfold(lab, "label", 5, "case_key", 42)


@register("cv_summary", f"""
WITH {LABELLED_SQL}, {_KFOLD_SQL},
c AS (SELECT fold, {_CONF_SQL.format(t='0.5')} FROM f GROUP BY fold),
m AS (SELECT fold, {_METRICS_SQL} FROM c)
SELECT avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std,
       avg(precision) AS precision_mean, stddev_pop(precision) AS precision_std,
       avg(recall) AS recall_mean, stddev_pop(recall) AS recall_std,
       avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std FROM m""")
def cv_summary_q(spark, sf_dir):
    """Metrics per fold (S3 folds, score >= 0.5) → mean and population std."""
    lab = labelled(spark, sf_dir)
    folds = SM.stratified_kfold(lab, "label", 5, "case_key", 42)
    per_fold = M.threshold_metrics(folds, "label", "score", 0.5, by=["fold"])
    return M.cv_summary(per_fold, ["accuracy", "precision", "recall", "f1"])


@register("kfold_ordered", """
WITH o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders),
c AS (SELECT label, count(*) AS n_c FROM o GROUP BY label),
s AS (SELECT label, n_c, coalesce(sum(n_c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM c),
a AS (SELECT label, i, greatest(ceil((st + n_c - i) / 5), 0) - greatest(ceil((st - i) / 5), 0) AS alloc
      FROM s, range(0, 5) t(i)),
b AS (SELECT label, i, sum(alloc) OVER (PARTITION BY label ORDER BY i) AS upper FROM a),
r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY o_orderkey) AS rk FROM o)
SELECT r.o_orderkey, r.label, CAST(count(b.i) AS BIGINT) AS fold
FROM r LEFT JOIN b ON r.label = b.label AND b.upper < r.rk
GROUP BY r.o_orderkey, r.label""")
def kfold_ordered_q(spark, sf_dir):
    """Unshuffled stratified folds of orders (label: status 'F') in key order."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return SM.kfold_ordered(o, "label", 5, "o_orderkey")


@register("shuffle_rank", f"""
WITH {LABELLED_SQL}
SELECT case_key, row_number() OVER (ORDER BY md5(concat_ws('|', '42', case_key)), case_key) AS shuffle_rank
FROM lab""")
def shuffle_rank_q(spark, sf_dir):
    """Full shuffle as a rank column (two-level rank, no global sort)."""
    lab = labelled(spark, sf_dir).select("case_key")
    return SM.shuffle_rank(lab, "case_key", 42)


@register("sample_n", f"""
WITH {LABELLED_SQL}
SELECT case_key, label, score FROM lab
ORDER BY md5(concat_ws('|', '42', case_key)), case_key LIMIT 1000""")
def sample_n_q(spark, sf_dir):
    """Exactly 1000 rows without replacement in md5 order."""
    lab = labelled(spark, sf_dir).select("case_key", "label", "score")
    return SM.sample_n(lab, 1000, "case_key", 42)


@register("class_weights", f"""
WITH {LABELLED_SQL}, c AS (SELECT label, count(*) AS n_c FROM lab GROUP BY label)
SELECT label, n_c, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM c""")
def class_weights_q(spark, sf_dir):
    """Balanced class weights n / (k * n_c)."""
    return M.class_weights(labelled(spark, sf_dir), "label")


@register("union_tables", f"""
WITH {LABELLED_SQL}
SELECT case_key, label, score, 'open' AS origin FROM lab WHERE l_linestatus = 'O'
UNION ALL SELECT case_key, label, score, 'filled' FROM lab WHERE l_linestatus = 'F'""")
def union_tables_q(spark, sf_dir):
    """H2: union by name of open and filled line items with an origin column."""
    lab = labelled(spark, sf_dir)
    a = lab.where(F.col("l_linestatus") == "O").select("case_key", "label", "score")
    b = lab.where(F.col("l_linestatus") == "F").select("score", "label", "case_key")
    return M.union_tables(a, b, "origin", ("open", "filled"))


@register("split_overlap", f"""
WITH {LABELLED_SQL}, {_holdout_sql('lab', 0.2, '42', 'j')}
SELECT {', '.join(FEATURES)} FROM j WHERE split = 'train'
INTERSECT SELECT {', '.join(FEATURES)} FROM j WHERE split = 'test'""")
def split_overlap_q(spark, sf_dir):
    """H4: distinct feature rows present in both train and test."""
    lab = labelled(spark, sf_dir)
    s = SM.stratified_holdout(lab, "label", 0.2, "case_key", 42)
    return M.split_overlap(s.where(F.col("split") == "train"),
                           s.where(F.col("split") == "test"), FEATURES)
