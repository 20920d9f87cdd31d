"""Activity matrices and their tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def activity(segments: DataFrame, invocations: DataFrame, window: int) -> DataFrame:
    """(session, idx, invocation, state): segments against the invocations of their session, cell by cell; for single rows and columns of a matrix.

    root: the invocation's own segment; candidate: within the window before it; existed: older; absent: newer. A session's
    invocations meet only its own segments.
    """
    rows = segments.select("session", "idx").join(invocations.select("session", F.col("idx").alias("invocation")), "session")
    state = F.when(F.col("idx") == F.col("invocation"), "root").when(F.col("idx") > F.col("invocation"), "absent").when(F.col("idx") >= F.col("invocation") - window, "candidate").otherwise("existed")
    return rows.withColumn("state", state)


def activity_counts(segments: DataFrame, invocations: DataFrame, window: int) -> DataFrame:
    """(session, state, n): how many cells of a session's matrix have each state, for segments numbered from 0 without gaps.

    An invocation at i has one root, min(i, window) candidates, max(i - window, 0) older and all later segments absent: sums over the
    invocations, so that no cell is built. States without cells have no row.
    """
    i = F.col("idx").cast("long")
    counted = lambda state, n: F.struct(F.lit(state).alias("state"), n.alias("n"))
    sums = invocations.groupBy("session").agg(F.count("*").alias("_m"), F.sum(F.least(i, F.lit(window))).alias("_near"), F.sum(i).alias("_all"))
    met = sums.join(segments.groupBy("session").agg(F.count("*").alias("_n")), "session")
    states = [counted("root", F.col("_m")), counted("candidate", F.col("_near")), counted("existed", F.col("_all") - F.col("_near")), counted("absent", F.col("_m") * (F.col("_n") - 1) - F.col("_all"))]
    return met.select("session", F.inline(F.array(*states))).where("n > 0")


def tiles(segments: DataFrame, invocations: DataFrame, window: int, height: int, width: int) -> DataFrame:
    """(session, row, col, state, cells): blocks of the matrix with their strongest state, for segments numbered from 0 without gaps.

    A tile comes from its rows' range and its columns' at most ``width`` invocations; its cells are not built. So the work is that of the tiles.
    """
    rows = segments.groupBy("session", F.floor(F.col("idx") / height).alias("row")).agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    cols = invocations.groupBy("session", F.floor(F.col("idx") / width).alias("col")).agg(F.collect_list("idx").alias("_at"))
    some = lambda f: F.exists("_at", f)
    root = some(lambda i: i.between(F.col("_lo"), F.col("_hi")))
    near = some(lambda i: F.greatest(F.col("_lo"), i - window) <= F.least(F.col("_hi"), i - 1))
    state = F.when(root, "root").when(near, "candidate").when(some(lambda i: i > F.col("_lo")), "existed").otherwise("absent")
    return rows.join(cols, "session").select("session", "row", "col", state.alias("state"), ((F.col("_hi") - F.col("_lo") + 1) * F.size("_at")).cast("long").alias("cells"))
