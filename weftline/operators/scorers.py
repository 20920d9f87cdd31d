"""What gives pairs of segments their weights: a parameter of every operator that scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import overlap, token_set

#: Source of scores that a model gave, and of those that are worked out from the texts; fixed values.
MODEL, LOCAL = "s1-noul", "lexical"


@dataclass(frozen=True)
class Scorer:
    """A function from pairs to weights.

    ``features`` are columns of a segment, worked out once for each segment; ``score`` takes pairs (session, from_idx, to_idx, a, b), where
    a and b are structs of idx and the features of the older and the newer segment, and adds ``w``. It may be any DataFrame function: an
    expression, a join with scores from elsewhere, an Arrow function. A null, or a number that is not finite or outside 0 to 1, is no
    answer. A ``refused`` column, if it adds one, marks rows of pairs that can't be taken now.
    """

    source: str
    features: Callable[[], list[Column]]
    score: Callable[[DataFrame], DataFrame]

    def prepared(self, segments: DataFrame) -> DataFrame:
        """(session, idx, features...)."""
        return segments.select("session", "idx", *self.features())

    def names(self, segments: DataFrame) -> list[str]:
        return [c for c in self.prepared(segments).columns if c not in ("session", "idx")]

    def joined(self, pairs: DataFrame, segments: DataFrame) -> DataFrame:
        """Scores of the pairs (session, from_idx, to_idx, ...) that are asked for; features come by joins on the segments' keys."""
        made = self.prepared(segments)
        side = lambda key, name: made.select("session", F.col("idx").alias(key), F.struct("idx", *self.names(segments)).alias(name))
        return self.score(pairs.join(side("from_idx", "a"), ["session", "from_idx"]).join(side("to_idx", "b"), ["session", "to_idx"])).drop("a", "b")


def valid(w: Column) -> Column:
    return F.coalesce(~F.isnan(w) & (w >= 0) & (w <= 1), F.lit(False))


def _overlaps(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("w", overlap(F.col("a.tokens"), F.col("b.tokens")))


def topic_weight(a: Column, b: Column) -> Column:
    """Same topic: 0.9 less 0.02 for each segment between, so that it fades over a window; else what the topics' distance leaves of a half."""
    apart = F.abs(a["topic"] - b["topic"])
    return F.when(apart == 0, 0.9 - 0.02 * (b["idx"] - a["idx"] - 1)).otherwise(0.5 / (1 + apart))


def _topics(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("w", topic_weight(F.col("a"), F.col("b")))


#: Overlap of token sets, and a fixed rule over events' topics that stands for a model.
LEXICAL = Scorer(LOCAL, lambda: [token_set(F.col("text")).alias("tokens")], _overlaps)
TOPICS = Scorer(MODEL, lambda: [F.col("topic"), F.col("ts")], _topics)
