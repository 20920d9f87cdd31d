"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import PLAIN, SPACES, checkpointed, chunks, id_back, keyed, range_hashes, utf8, word_spans

#: The model is fitted on at most so many labelled rows (those of least hash); three quarters grow trees, the rest calibrate.
TRAIN_ROWS = 20_000
#: Words taken into the fitted lexicon: at most so many, of those found in so many toxic rows and mostly in toxic ones.
FITTED_WORDS, TOXIC_ROWS, TOXIC_SHARE = 64, 3, 0.6
TREES, DEPTH = 20, 3
#: A second-person word within so many words of a lexicon word counts as near.
NEAR = 5
#: Insults, fixed values.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown clowns imbecile fool freak jerk bastard bitch asshole crap shit fuck fucking hate kill die ugly vermin filth garbage crétin débile connard salaud ordure minable dégoûtant abruti idiot trottel dumm dummkopf abschaum widerlich erbärmlich versager arschloch scheiße imbécil estúpido basura asqueroso patético perdedor escoria gilipollas mierda payaso".split()
#: Second-person words, fixed values.
SECOND = "you your yours youre yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tuyo usted ustedes vosotros".split()
FEATURES = ["log_words", "insults", "insult_any", "fitted", "fitted_any", "near_second", "second", "capitals", "all_caps", "exclaims", "questions", "punctuation", "obfuscated", "hidden", "single_letters"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters that stand in for others in hidden words, fixed values.
_SHOWN = _LOWER.copy()
for _a, _b in zip(b"@0134577$", b"aoieasttt", strict=True):
    _SHOWN[_a] = _b
_SHOWN[ord("5")], _SHOWN[ord("$")] = ord("s"), ord("s")
_LETTER = np.array([chr(c).isalpha() or c > 127 for c in range(256)])
_SIGN = np.zeros(256, bool)
_SIGN[list(b"@$*#!0123456789")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.array([c < 128 and 32 < c and not chr(c).isalnum() for c in range(256)])


def _hashes(words: list[str]) -> np.ndarray:
    data, at = utf8(pa.array(sorted(set(words)), pa.string()))
    return np.unique(range_hashes(data, at[:-1], at[1:]))


def features(col: pa.Array, fitted: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; densities are per word or per byte."""
    raw, raw_at = utf8(col)
    data, at = utf8(pc.utf8_lower(col))
    starts, ends, bounds = word_spans(data, at, PLAIN)
    words, n = range_hashes(data, starts, ends), np.diff(bounds)
    per = np.maximum(n, 1)

    def each(mask: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[cuts[1:]] - total[cuts[:-1]]

    insult, own, second = (np.isin(words, x) for x in (_hashes(INSULTS), fitted, _hashes(SECOND)))
    bad, row = insult | own, np.repeat(np.arange(len(n)), n)
    near = np.zeros(len(words), bool)
    for step in range(1, NEAR + 1):
        same = row[step:] == row[:-step]
        near[step:] |= bad[step:] & second[:-step] & same
        near[:-step] |= bad[:-step] & second[step:] & same
    size = np.maximum(np.diff(raw_at), 1)
    letters = np.maximum(each(_LETTER[raw], raw_at), 1)
    inside = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inside[1:-1] = _SIGN[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    tokens, token_ends, token_bounds = word_spans(raw, raw_at, SPACES)
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    shouted = (upper[token_ends] - upper[tokens] >= 3) & (upper[token_ends] - upper[tokens] >= token_ends - tokens - 1)
    single = (token_ends - tokens == 1) & _LETTER[raw[tokens]] if len(tokens) else np.zeros(0, bool)
    shown = _SHOWN[raw]
    s, e, b = word_spans(shown, raw_at, PLAIN)
    revealed = each(np.isin(range_hashes(shown, s, e), np.union1d(_hashes(INSULTS), fitted)), b)
    plain = each(bad, bounds)
    counts = each(insult, bounds), each(own, bounds)
    return np.stack(
        [
            np.log1p(n), counts[0] / per, np.minimum(counts[0], 5), counts[1] / per, np.minimum(counts[1], 5), each(near, bounds) / per, each(second, bounds) / per, each(_UPPER[raw], raw_at) / letters, each(shouted, token_bounds) / per,
            each(raw == ord("!"), raw_at) / size, each(raw == ord("?"), raw_at) / size, each(_PUNCT[raw], raw_at) / size, each(inside, raw_at) / per, np.maximum(revealed - plain, 0) / per, each(single, token_bounds) / per,
        ],
        1,
    ).astype(np.float64)


@dataclass
class ToxicityModel:
    """Trees over FEATURES, the fitted lexicon's hashes, and the steps of the calibration. Without trees, one base rate."""

    words: np.ndarray
    trees: GBTClassificationModel | None
    steps: tuple[list[float], list[float]]
    base: float


def feature_rows(texts: DataFrame, fitted: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_x``, the features of ``_text``."""

    def rows(batches):
        for batch in chunks(batches):
            x = features(batch.column(batch.schema.get_field_index("_text")), fitted)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), lists], [*keep, "_x"])

    kinds = dict(texts.dtypes)
    return texts.select(*keep, "_text").mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", _x array<double>")


def remainder(id_col: str = "_id"):
    """crc32 of the id as text, modulo 5: rows of remainder 0 are held out of all fitting."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits lexicon, trees and calibration on at most ``rows`` labelled rows of least hash, none of them held out."""
    own = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").where(remainder() != 0)
    sample = own.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # the sample is bounded by ``rows``, so it can be sent to every task: the texts stay where they are
    texts = checkpointed(keyed(docs, id_col, text_col).join(F.broadcast(sample), "_id").dropDuplicates(["_id", "_k"]))
    whole = texts.agg(F.count("_y").alias("n"), F.sum("_y").alias("toxic")).first()
    if not whole["n"] or not whole["toxic"] or whole["toxic"] == whole["n"]:
        return ToxicityModel(np.zeros(0, np.uint64), None, ([], []), (whole["toxic"] or 0) / whole["n"] if whole["n"] else 0.0)
    toxic = F.sum("_y")
    lexicon = texts.where(remainder() != 4).select("_y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0))).alias("_w")).groupBy("_w").agg(toxic.alias("_t"), F.count("_y").alias("_n"))
    best = lexicon.where((F.col("_t") >= TOXIC_ROWS) & (F.col("_t") >= TOXIC_SHARE * F.col("_n"))).orderBy(F.desc(F.col("_t") - (F.col("_n") - F.col("_t")) * 3), "_w").limit(FITTED_WORDS).collect()
    words = _hashes([r["_w"] for r in best]) if best else np.zeros(0, np.uint64)
    data = feature_rows(texts, words, ["_id", "_y"]).select("_id", F.col("_y").cast("double").alias("label"), array_to_vector("_x").alias("features"))
    data = checkpointed(data.repartition(2))
    grow, calibrate = data.where(remainder() != 4), data.where(remainder() == 4)
    if grow.where("label > 0").isEmpty():
        grow = data
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32, cacheNodeIds=False).fit(grow)
    steps = ([], [])
    scored = trees.transform(calibrate).select("label", vector_to_array("probability")[1].alias("p"))
    if not calibrate.where("label > 0").isEmpty():
        fitted = IsotonicRegression(featuresCol="f", labelCol="label").fit(VectorAssembler(inputCols=["p"], outputCol="f").transform(scored))
        steps = (fitted.boundaries.toArray().tolist(), fitted.predictions.toArray().tolist())
    return ToxicityModel(words, trees, steps, whole["toxic"] / whole["n"])


def calibrated(p, steps: tuple[list[float], list[float]]):
    """The isotonic value at p, linear between its boundaries and constant beyond; a little of p itself keeps the order."""
    bounds, values = steps
    if not bounds:
        return p
    out = F.lit(float(values[-1]))
    for (a, x), (b, y) in reversed(list(zip(zip(bounds, values), zip(bounds[1:], values[1:])))):
        line = F.lit(float(x)) + (p - a) * ((y - x) / (b - a)) if b > a and y > x else F.lit(float(x))
        out = F.when(p < b, line).otherwise(out)
    return 0.98 * F.when(p <= bounds[0], F.lit(float(values[0]))).otherwise(out) + 0.02 * p


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the features of every document, scored by its whole text alone.

    Null texts are scored as empty ones; null ids stay null and are never held out; repeated rows give repeated results; an
    empty table gives no rows. Without labels of both kinds the score is their base rate (0 without labels).
    """
    rows = feature_rows(keyed(docs, id_col, text_col), model.words, ["_id"])
    if model.trees is None:
        score = F.lit(float(model.base))
    else:
        rows = model.trees.setFeaturesCol("_f").transform(rows.withColumn("_f", array_to_vector("_x"))).withColumn("_p", vector_to_array("probability")[1])
        score = calibrated(F.col("_p"), model.steps)
    rows = rows.select(id_back().alias("doc_id"), (F.coalesce(remainder(), F.lit(1)) == 0).alias("held_out"), score.alias("score"), F.col("_x").alias("features"))
    return rows.withColumn("held_out", F.col("held_out") & F.col("doc_id").isNotNull()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
