"""Toxicity scores: gradient-boosted trees over dense features, with isotonic
calibration.

Features of a text are lexicon densities, second-person proximity, and rates of
capitals, punctuation and obfuscation. The lexicon is learned from the labelled
rows (words and word beginnings that go with the label) beside a short list of
insults; a training row's own count is taken out of the weights it sees.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialise, slices, text_batches

#: Labelled rows that a fit uses at most (about: rows below a hash level), and
#: terms that the learned lexicon holds at most. All rows are scored.
FIT_ROWS, LEXICON_TERMS = 20_000, 8_192
THRESHOLD = 0.7
#: Plain insults; other terms are learned.
INSULTS = "idiot moron stupid scum trash loser clown worthless pathetic disgusting dumb ugly fool jerk bastard".split()
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine tu toi te ton ta vous votre tú ti usted ustedes su".split())
STEM = 4
NEAR = 6
_WORD = re.compile(r"\w+")
_LEET = str.maketrans("013457@$!|+", "oieastasilt")
#: A whole run of digits and marks before a letter; it starts at the run's start alone,
#: so that a long run is read once.
_MARKS = re.compile(r"(?<![0-9@$!*|+])([0-9@$!*|+]++)(?=[^\W\d_])")
_RUNS = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?!\w)")
_UPPER_WORD = re.compile(r"\b[A-Z]{3,}\b")
FEATURES = ("words", "hits", "density", "weight", "weight_rate", "top", "distinct", "insults", "near_you", "you",
            "capitals", "shouted", "exclaimed", "asked", "punctuation", "mixed", "runs", "hidden")


def terms(words: list[str]) -> set[str]:
    """Lexicon terms of a text: its words, and beginnings of its longer words."""
    own = set(words)
    return own | {"^" + w[:STEM] for w in own if len(w) > STEM}


def term_weight(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Log odds of the term given the label, less one standard error; at least 0."""
    odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return max(0.0, odds - math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))


def mixed_words(low: str) -> list[str]:
    """Stretches without white space in which digits or marks stand between a letter or
    digit and a letter. Linear in the text, however long a stretch is."""
    def inside(w: str) -> bool:
        return any(w[m.start() - 1:m.start()].isalnum() or any("0" <= c <= "9" for c in m[1][:-1]) for m in _MARKS.finditer(w))
    return [w for w in low.split() if not w.isalpha() and inside(w)]


def features_of(text: str, lexicon: dict[str, tuple[int, int]], n_pos: int, n_neg: int, label: int | None = None) -> list[float]:
    """FEATURES of a whole text. With a label, the row's own part in the lexicon's
    counts is taken out."""
    low = text.lower()
    words = _WORD.findall(low)
    n, size = max(1, len(words)), max(1, len(text))
    out = 0 if label is None else 1

    def weigh(term: str) -> float:
        c = lexicon.get(term)
        if c is None:
            return 0.0
        p, q = c[0] - (out and label), c[1] - (out and 1 - label)
        return term_weight(max(0, p), max(0, q), max(0, n_pos - (out and label)), max(0, n_neg - (out and 1 - label)))

    weights = {w: max(weigh(w), weigh("^" + w[:STEM]) if len(w) > STEM else 0.0, 3.0 if w in _INSULTS else 0.0) for w in set(words)}
    strong = {w for w, x in weights.items() if x >= 1.5}
    places = [i for i, w in enumerate(words) if w in strong] if strong else []
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if places and you:
        at = np.searchsorted(you, places)
        y = np.array([-10**9, *you, 10**9])
        near = int((np.minimum(np.abs(y[at] - places), np.abs(y[at + 1] - places)) <= NEAR).sum())
    mixed = mixed_words(low)
    hidden = sum(1 for m in mixed for w in _WORD.findall(m.translate(_LEET)) if w in _INSULTS or weigh(w) >= 1.5)
    spaced = _SPACED.findall(low)
    hidden += sum(1 for m in spaced if re.sub(r"\W|_", "", m) in _INSULTS)
    weight = sum(weights[words[i]] for i in places)
    letters = sum(map(str.isalpha, text))
    capitals = sum(map(str.isupper, text))
    return [math.log1p(n), math.log1p(len(places)), len(places) / n, math.log1p(weight), weight / n,
            max(weights.values(), default=0.0), float(len(strong)), math.log1p(sum(w in _INSULTS for w in words)), near / n, len(you) / n,
            capitals / max(1, letters), len(_UPPER_WORD.findall(text)) / n, text.count("!") / size, text.count("?") / size,
            sum(map(text.count, ".,;:!?*#$%&@")) / size, len(mixed) / n, len(_RUNS.findall(low)) / n, math.log1p(hidden)]


_INSULTS = frozenset(INSULTS)


def feature_rows(docs: DataFrame, lexicon: dict[str, tuple[int, int]], n_pos: int, n_neg: int) -> DataFrame:
    """The columns of docs but text, and FEATURES; docs has text, and label where
    a row's own part is to be taken out of the lexicon's counts."""
    held = docs.sparkSession.sparkContext.broadcast((lexicon, n_pos, n_neg))
    keep = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(f, DoubleType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            labels = part.column("label").to_pylist() if "label" in keep else [None] * len(texts)
            x = np.array([features_of(t.decode("utf-8", "replace"), *held.value, label)
                          for t, label in zip(texts, labels, strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x[:, k]) for k in range(len(FEATURES))],
                                             [*keep, *FEATURES])
    return docs.mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame, most: int = LEXICON_TERMS) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Term -> (toxic, other) document counts over sample (text, label), the
    ``most`` terms of the largest weight; and the two numbers of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (labels,), texts in text_batches(batches, "label", limit=2 << 20):
            own: dict[str, list[int]] = {}
            for y, t in zip(labels, texts, strict=True):
                for w in terms(_WORD.findall(t.decode("utf-8", "replace").lower())):
                    own.setdefault(w, [0, 0])[0 if y else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(own), pa.string()), pa.array([c[0] for c in own.values()], pa.int64()),
                 pa.array([c[1] for c in own.values()], pa.int64())], ["term", "pos", "neg"])
    n_pos, n_neg = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    counts = (sample.select("label", "text").mapInArrow(run, "term string, pos long, neg long")
              .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3"))
    odds = (F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
            - F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
    rows = (counts.withColumn("w", odds).where("w > 0.5 AND length(term) >= 3").orderBy(F.desc("w"), "term").limit(most).collect())
    return {r["term"]: (r["pos"], r["neg"]) for r in rows}, n_pos, n_neg


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    labels (doc_id, toxic 0/1) teach only where crc32(doc_id) mod 3 is not 1; null
    labels and labels without a document teach nothing. The fit takes about
    fit_rows labelled rows, by a hash of doc_id (all of them when there are
    fewer): one in five calibrates, the others give the lexicon and the trees.
    Without rows of both labels every score is the toxic share seen (0 without
    labels). Null and empty texts are scored as a text without words; repeated
    rows are scored alike.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scorer(src, labels, fit_rows)(src).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least threshold; all columns stay. Rows
    are judged in place, without a join."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return _scorer(src, labels, fit_rows)(rows).where(F.col("score") < threshold).select("row.*")


def _scorer(src: DataFrame, labels: DataFrame, fit_rows: int):
    """Function that adds score to rows with text (and takes text away)."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .where(~held_out()))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(int(share * (1 << 62))))
    # about fit_rows rows of 12 bytes: a broadcast that does not grow with the data
    sample = materialise(src.join(F.broadcast(chosen), "doc_id")
                         .withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0), "sample")
    teach, check = sample.where("NOT calibrates").drop("calibrates"), sample.where("calibrates").drop("calibrates")
    lexicon, n_pos, n_neg = learn_lexicon(teach)
    if n_pos == 0 or n_neg == 0:
        return lambda rows: rows.drop("text").withColumn("score", F.lit(float(n_pos > 0)))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = materialise(feature_rows(teach, lexicon, n_pos, n_neg), "train").coalesce(4)
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=24, maxDepth=3, stepSize=0.2, maxBins=48,
                          minInstancesPerNode=4, seed=5).fit(x.transform(train))

    def raw(rows: DataFrame) -> DataFrame:
        return trees.transform(x.transform(feature_rows(rows, lexicon, n_pos, n_neg))).withColumn("raw", vector_to_array("probability")[1])

    seen = materialise(raw(check.withColumnRenamed("label", "told")).select("raw", F.col("told").cast("double").alias("told")), "seen")
    both = seen.agg(F.sum("told"), F.count("told")).first()
    steps = None
    if both[1] and 0 < both[0] < both[1]:
        steps = IsotonicRegression(featuresCol="raw", labelCol="told").fit(seen)

    def score(rows: DataFrame) -> DataFrame:
        out = raw(rows)
        # a part of the raw score keeps the order within a step of the calibration
        value = F.col("raw") if steps is None else 0.98 * F.col("prediction") + 0.02 * F.col("raw")
        if steps is not None:
            out = steps.transform(out.drop("prediction"))
        return out.select(*[c for c in rows.columns if c != "text"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))
    return score
