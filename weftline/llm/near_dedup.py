"""Near-duplicate classes: ProbMinHash signatures, banding, and exact verification of the probability Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import FEW, FEW_TASKS, NO_ID, PLAIN, checkpointed, chunks, column, gram_hashes, id_back, keyed, mixed, range_hashes, release_memory, saved, utf8, word_spans

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
#: Buckets of so many members that their leader leaves open are compared pair by pair in the next round (twice as many in each round);
#: larger ones are parted, for so many rounds.
SMALL, ROUNDS = 6, 5
#: As soon as there are so many open pairs for each row of a bucket, they are compared and no further round is made.
ENOUGH = 24
#: About so many members (twice as many at most, by hash) tell what most of their group have. It bears on the cost only.
ASKED = 32
#: So much of a member's and that reference's shingles together must be common for it to lead the group in place of the most famous one.
LEADS = 0.5
#: Stretches of the leader in which it is counted how many of its shingles a member lacks.
STRETCHES = 16
#: What rounding may take from a similarity.
EPSILON = 1e-9
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(col: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row: row, hash and number of times, in order of row and place. A row of fewer words is one shingle."""
    data, at = utf8(pc.utf8_lower(col))
    starts, ends, bounds = word_spans(data, at, PLAIN)
    words = range_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(col)), np.diff(bounds))
    grams = gram_hashes(words, n)
    whole = np.flatnonzero(row[: len(grams)] == row[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    size = np.diff(bounds)
    short = np.flatnonzero((size > 0) & (size < n))
    row = np.concatenate((row[whole], short))
    grams = np.concatenate((grams[whole], range_hashes(words, bounds[short], bounds[short + 1])))
    _, first, times = np.unique(mixed(grams + row.astype(np.uint64) * _GOLDEN), return_index=True, return_counts=True)
    order = np.lexsort((first, row[first]))
    return row[first][order], grams[first][order], times[order]


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: a rows x registers array of the elements that arrive first.

    Each element arrives by a Poisson process of its weight's rate, with exponential gaps drawn from the element's hash, and each
    arrival falls into one register. A register keeps its first arrival. An element stops as soon as it is later than all of
    its row's registers, so most draw once. Two rows agree in a register with the probability Jaccard similarity of their weights.
    """
    first, owner = np.full(rows * registers, np.inf), np.zeros(rows * registers, np.uint64)
    time, state = np.zeros(len(row)), element.copy()
    while len(row):
        state = mixed(state + _GOLDEN)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = row * registers + (mixed(state ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        before = first[slot]
        np.minimum.at(first, slot, time)
        won = (time == first[slot]) & (time < before)
        owner[slot[won]] = element[won]
        more = time < first.reshape(rows, registers).max(1)[row]
        row, element, weight, time, state = row[more], element[more], weight[more], time[more], state[more]
    return owner.reshape(rows, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets (elements, weights): the sum over common d of
    1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # for d: elements of a ratio up to d's take a's side of the maximum, the others b's
    upto = np.searchsorted(ratio, ratio, "right")
    sum_x, sum_y = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    return float((1 / ((only_a + sum_x[upto]) / x + (only_b + sum_y[-1] - sum_y[upto]) / y)).sum())


def band_rows(docs: DataFrame) -> DataFrame:
    """(_id, _k, _bands): the hash of each band of the signature; none for a text without words."""

    def rows(batches):
        for batch in chunks(batches):
            row, element, times = shingles(batch.column(batch.schema.get_field_index("_text")))
            got = signatures(row, element, times.astype(float), batch.num_rows).reshape(-1, BANDS, ROWS)
            key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], batch.num_rows, 0)
            for r in range(ROWS):
                key = mixed(key * _GOLDEN + got[:, :, r])
            has = np.bincount(row, minlength=batch.num_rows) > 0
            at = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(key[has].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "_id")), pa.array(column(batch, "_k")), lists], ["_id", "_k", "_bands"])

    return docs.mapInArrow(rows, "_id long, _k long, _bands array<long>")


def met(table: DataFrame, most: int | None = None) -> DataFrame:
    """The table, which goes to all tasks where it has few rows (``most``, or counted if it is saved), so that what meets it isn't moved."""
    return F.broadcast(table) if (table.count() if most is None else most) <= FEW else table


def needed(texts: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """The texts that the pairs name. Few keys go to all tasks, so that other texts need not be moved."""
    keys = pairs.select(F.explode(F.array("_k", "_l")).alias("_k"))
    return texts.join(F.broadcast(keys) if few else keys.distinct(), "_k", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, similar: float, most: int, references: DataFrame | None = None) -> DataFrame:
    """Each of at most ``most`` pairs (_g, _l, _k, _large) with ``_ok``: whether it reaches that similarity.

    Pairs of large groups, whose leaders' texts are in ``references`` (see there), also say how k stands to the group's reference: k's
    weight, its weight on the reference, how many of the reference it lacks, in all and by stretch of the leader, and ``_own``, its
    shingles besides the reference, in order of hash, as far as their weight first exceeds 1 - similar of k's.
    """
    schema = "_g long, _l long, _k long, _large boolean, _ok boolean, _w long, _wl long, _lacks long, _by array<int>, _own array<long>"

    def rows(batch):
        sides = []
        for name in ("_a", "_b"):
            row, element, times = shingles(batch.column(batch.schema.get_field_index(name)))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sides.append([(element[x:y], times[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)])
        out = []
        common = batch.column(batch.schema.get_field_index("_common"))
        for large, a, b, most_have in zip(batch.column(batch.schema.get_field_index("_large")).to_pylist(), *sides, common, strict=True):
            ok = similarity(a, b) >= similar - EPSILON
            if not large:
                out.append((ok, None, None, None, None, None))
                continue
            reference = most_have.values.to_numpy().view(np.uint64) if most_have.is_valid else a[0]
            # the stretch of the leader that each shingle of the reference is from; those that the leader lacks are one more
            order = np.argsort(a[0])
            at = np.searchsorted(a[0][order], reference).clip(0, max(len(order) - 1, 0))
            place = np.full(len(reference), STRETCHES)
            if len(order):
                there = a[0][order][at] == reference
                place[there] = order[at[there]] * STRETCHES // len(order)
            lacks = np.bincount(place[~np.isin(reference, b[0])], minlength=STRETCHES + 1)
            shared, weight = np.isin(b[0], reference), int(b[1].sum())
            own, times = b[0][~shared], b[1][~shared]
            order = np.argsort(own)
            upto = np.searchsorted(np.cumsum(times[order]), (1 - similar + EPSILON) * weight, "right") + 1
            out.append((ok, weight, weight - int(times.sum()), int(lacks.sum()), lacks, own[order][:upto].view(np.int64)))
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        keep = ["_g", "_l", "_k", "_large"]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *cols], [*keep, "_ok", "_w", "_wl", "_lacks", "_by", "_own"])

    def small(batches):
        for batch in batches:
            for part in chunks([batch], "_a"):
                for some in chunks([part], "_b"):
                    yield rows(some)
        release_memory()

    few = most * 2 <= FEW
    named = needed(texts, pairs, few)
    leads = named.select(F.col("_k").alias("_g"), F.col("_k").alias("_l"), F.lit(False).alias("_large"), F.col("_text").alias("_a"), F.lit(None).cast("array<bigint>").alias("_common"))
    if references is not None:
        leads = leads.union(references.select("_g", "_l", F.lit(True), "_a", "_common"))
    joined = leads.join(F.broadcast(pairs) if few else pairs, ["_g", "_l", "_large"]).join(named.select("_k", F.col("_text").alias("_b")), "_k")
    joined = joined.select("_g", "_l", "_k", "_large", "_a", "_b", "_common")
    return (joined.coalesce(4 * FEW_TASKS) if few else joined).mapInArrow(small, schema)


def references(group: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(_g, _l, _a, _common): for each group (_g, _l, _k; at most ``most`` rows) a leader, its text, and the shingles that most members have.

    A leader that is a copy itself lacks shingles that others share, which then seem to be their own. So members are held against
    the shingles that more than half of some of them (of least hash, and the most famous) have, be they together in one text or not.
    The one of these members that is most like that leads; the most famous one does if none is like it. Any reference and leader give
    the same links.
    """

    def sets(batches):
        for batch in chunks(batches):
            row, element, _ = shingles(batch.column(batch.schema.get_field_index("_text")))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(element.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "_g")), pa.array(column(batch, "_k")), lists], ["_g", "_k", "_e"])

    few = most * 2 <= FEW
    size = group.groupBy("_g").agg(F.count("_k").alias("_n"))
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / ASKED))
    asked = group.join(size, "_g").where(F.pmod(F.xxhash64("_k"), every) == 0).select("_g", "_k").union(size.select("_g", F.col("_g")))
    asked = saved(asked, most)
    told = (texts.join(F.broadcast(asked), "_k") if few else texts.join(asked, "_k")).select("_g", "_k", "_text")
    have = saved(told.mapInArrow(sets, "_g long, _k long, _e array<long>"), most)
    half = have.groupBy("_g").agg((F.count("_k") / 2).alias("_half"))
    hits = have.select("_g", F.explode("_e").alias("_e")).groupBy("_g", "_e").agg(F.count("_e").alias("_n"))
    common = hits.join(half, "_g").where("_n > _half").groupBy("_g").agg(F.collect_list("_e").alias("_common"))
    both = F.size(F.array_intersect("_e", "_common"))
    like = have.join(common, "_g").select("_g", "_k", "_common", (both / (F.size("_e") + F.size("_common") - both)).alias("_like"))
    best = like.groupBy("_g").agg(F.max(F.struct("_like", "_k")).alias("_best"), F.first("_common").alias("_common"))
    lead = size.select("_g").join(best, "_g", "left").select("_g", F.when(F.col("_best._like") >= LEADS, F.col("_best._k")).otherwise(F.col("_g")).alias("_l"), "_common")
    lead = saved(lead, most)
    named = texts.select(F.col("_k").alias("_l"), F.col("_text").alias("_a"))
    return saved((named.join(F.broadcast(lead), "_l") if few and most <= FEW // 10 else named.join(lead, "_l")).select("_g", "_l", "_a", "_common"), most)


def parted(group: DataFrame, similar: float) -> DataFrame:
    """(_key, _k, _c): smaller buckets of members (_g, _k, _c, ...) of groups, so that any two of one group that may be similar share one.

    Order a member's shingles: those besides the group's reference first. Two similar members share one among the first fifth
    (1 - similar) of their weights. Either it is none of the reference's: they share a bucket by it. Or both have four fifths on the
    reference's shingles; then, if none of their own are common, m has at most ``_wl`` less the reference's shingles that s lacks and
    m doesn't in common with s, and so the other way. In each stretch these are no fewer than s lacks more there than m. With x and y the
    shares in common, similarity is at most 1 / (1 / x + 1 / y - 1). Members of equal figures are judged as one.
    """
    figures = ["_w", "_wl", "_lacks", "_by"]
    by_own = group.select("_g", "_k", "_c", F.explode("_own").alias("_e")).select(F.xxhash64("_g", "_e").alias("_key"), "_k", "_c")
    near = group.where(F.col("_wl") >= (similar - EPSILON) * F.col("_w"))
    kinds = near.groupBy("_g", *figures).agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"))
    one, two = kinds.alias("one"), kinds.alias("two")

    def bound(missed: list) -> Column:
        less = [F.col(f"{x}._wl") - m for x, m in zip(("one", "two"), missed, strict=True)]
        return (less[0] > 0) & (less[1] > 0) & (1 / (F.col("one._w") / less[0] + F.col("two._w") / less[1] - 1) >= similar - EPSILON)

    sides = (("two", "one"), ("one", "two"))
    in_all = bound([F.greatest(F.col(f"{x}._lacks") - F.col(f"{y}._lacks"), F.lit(0)) for x, y in sides])
    more = [F.zip_with(f"{x}._by", f"{y}._by", lambda p, q: F.greatest(p - q, F.lit(0))) for x, y in sides]
    by_stretch = bound([F.aggregate(m, F.lit(0), lambda total, p: total + p) for m in more])
    once = F.struct(*[f"one.{c}" for c in figures]) <= F.struct(*[f"two.{c}" for c in figures])
    open_ = F.least("one._low", "two._low") < F.greatest("one._high", "two._high")
    may = one.join(two, (F.col("one._g") == F.col("two._g")) & once & open_ & in_all & by_stretch)
    key = F.xxhash64("one._g", *[f"{x}.{c}" for x in ("one", "two") for c in figures])
    ends = may.select(key.alias("_key"), F.col("one._g").alias("_g"), F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in figures]) for x in ("one", "two")]))).alias("_f"))
    by_kind = ends.select("_key", "_g", "_f.*").join(near, ["_g", *figures]).select("_key", "_k", "_c")
    return by_own.union(by_kind).distinct()


def leaders(many: DataFrame, most: int) -> DataFrame:
    """(_key, _l): whom the members of each bucket (_key, _k, _n) are compared with; ``most`` bounds their rows.

    A member's fame is the size of all its buckets together: among copies the original, which shares a bucket with almost each of
    them, has most. A member's hub is the most famous one that it shares a bucket with, and a bucket's leader the hub that most of
    its members have, whether it is in the bucket or not. So a family has one leader, and a member is compared with it once,
    however many buckets it is in.
    """
    # a member's window holds its own buckets only, a few for each of its words at most
    own = W.partitionBy("_k")
    famous = saved(many.select("_key", "_k", F.sum("_n").over(own).alias("_f")), most)
    top = famous.groupBy("_key").agg(F.max(F.struct("_f", "_k")).alias("_top"))
    hub = famous.join(met(top, most), "_key").select("_key", "_k", F.max("_top").over(own).alias("_hub"))
    votes = hub.groupBy("_key", "_hub").agg(F.count("_k").alias("_votes"))
    return votes.groupBy("_key").agg(F.max(F.struct("_votes", "_hub")).alias("_best")).select("_key", F.col("_best._hub._k").alias("_l"))


def linked(docs: DataFrame, bands: DataFrame, similar: float) -> DataFrame | None:
    """(_k, _c): the least text hash of each linked text's component; None without links. Over texts that share a band.

    A large bucket is never expanded into its pairs: its members are verified against its leader (see ``leaders``), which links most of
    them. What is left of it, members of several components, is parted into smaller buckets (see ``parted``) for the next round.
    Buckets of two, small ones that their leader leaves in several components, and what is left of any after ROUNDS, are compared
    pair by pair, but for members of one component. So every two members of a bucket are compared, proven unlike or of one
    component: no link between components is lost.
    """
    once = bands.dropDuplicates(["_k"]).select("_k", F.explode("_bands").alias("_key"))
    shared = once.groupBy("_key").agg(F.count("_k").alias("_n")).where("_n > 1").select("_key")
    buckets = saved(once.join(shared, "_key").select("_key", "_k"))
    wanted = saved(buckets.select("_k").distinct().join(bands.select("_id", "_k"), "_k").groupBy("_k").agg(F.min("_id").alias("_id")))
    texts = saved(docs.join(met(wanted), ["_id", "_k"]).select("_k", "_text").dropDuplicates(["_k"]))
    labels = None

    def with_component(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_c", F.col("_k")) if labels is None else rows.join(met(labels), "_k", "left").withColumn("_c", F.coalesce("_c", "_k"))

    def still_open(named: DataFrame) -> DataFrame:
        """The rows of buckets with members of several components: ``_n`` members, ``_open`` pairs of them that are not of one component."""
        size = named.groupBy("_key", "_c").agg(F.count("_k").alias("_m")).groupBy("_key").agg(F.sum("_m").alias("_n"), F.sum(F.col("_m") * F.col("_m")).alias("_s"))
        size = size.select("_key", "_n", ((F.col("_n") * F.col("_n") - F.col("_s")) / 2).alias("_open")).where("_open > 0")
        return saved(named.join(size, "_key").select("_key", "_k", "_c", "_n", "_open"))

    def several(found: DataFrame, most: int) -> DataFrame:
        """The large groups with members of several components."""
        group = with_component(found.where("_large").drop("_large", "_ok"))
        open_ = group.groupBy("_g").agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_a < _b").select("_g")
        return saved(group.join(met(open_, most), "_g"), most)

    buckets = with_component(buckets)
    for left in range(ROUNDS, -1, -1):
        # buckets compared pair by pair now, and in the next round
        now, then = (2 if left == ROUNDS else SMALL << (ROUNDS - left - 1)), SMALL << (ROUNDS - left)
        buckets = still_open(buckets)
        # buckets whose open pairs are no more than ENOUGH for each of their rows end the rounds
        each = F.col("_open") / F.col("_n")
        by_pairs = (F.col("_n") <= now) | (F.lit(left < ROUNDS) & (each <= SMALL))
        size = buckets.agg(F.count("_k").alias("rows"), F.sum(each).alias("pairs"), F.sum(F.when(by_pairs, each).otherwise(1)).alias("led")).first()
        if not size["rows"]:
            break
        last = left == 0 or size["pairs"] <= ENOUGH * size["rows"]
        most = int(size["pairs"] if last else size["led"]) + 1
        few = buckets.where(by_pairs | F.lit(last))
        # two members of several common buckets are paired in the least of them only
        few = few.select("_key", "_k", "_c", F.collect_list("_key").over(W.partitionBy("_k")).alias("_keys"))
        other = few.select("_key", F.col("_k").alias("_l"), F.col("_c").alias("_d"), F.col("_keys").alias("_others"))
        least = F.array_min(F.array_intersect("_keys", "_others")) == F.col("_key")
        pairs = few.join(other, "_key").where(F.expr("_c <> _d AND _l < _k") & least).select("_l", "_k", F.lit(False).alias("_large"))
        if not last:
            many = buckets.where(~by_pairs)
            led = many.join(met(leaders(many, size["rows"]), size["rows"]), "_key").where("_l <> _k").select("_l", "_k", (F.col("_n") > then).alias("_large"))
            pairs = pairs.union(led)
        pairs = saved(pairs.groupBy("_l", "_k").agg(F.max("_large").alias("_large")).select(F.col("_l").alias("_g"), "_l", "_k", "_large"), most)
        most = pairs.count()
        held = None
        if not last:
            # large groups are compared with a leader that is like most of them; the most famous one is then a member
            large = pairs.where("_large").select("_g", "_k")
            held = references(large, texts, most)
            group = large.union(large.select("_g", F.col("_g")).distinct()).join(met(held.select("_g", "_l"), most), "_g").where("_k <> _l")
            most *= 2
            pairs = saved(pairs.where("NOT _large").union(group.select("_g", "_l", "_k", F.lit(True))), most)
        found = saved(verified(pairs, texts, similar, most, held))
        new = found.where("_ok").select("_l", "_k")
        if not new.isEmpty():
            labels = components(new, labels)
        if last:
            break
        group = several(found, most)
        waiting = with_component(buckets.where(~by_pairs & (F.col("_n") <= then)).select("_key", "_k"))
        buckets = saved(waiting.unionByName(parted(group, similar)))
    return labels


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(_k, _c): for each node the least node of its component, by least neighbours and pointer jumping.

    Components found before (_k, _c) count as links to their least nodes, so that their own links need not be walked again.
    A step takes the least of a node's own label, its neighbours' and its label's label, in one grouping; it reads saved tables only.
    """
    if before is not None:
        edges = edges.union(before.select(F.col("_c").alias("_l"), "_k"))
    both = edges.select("_l", "_k").union(edges.select("_k", "_l")).toDF("_k", "_o")
    most = both.count()
    labels = saved(both.groupBy("_k").agg(F.least(F.min("_o"), F.col("_k")).alias("_c")), most)
    unknown = F.lit(None).cast("long")
    while True:
        near = both.join(met(labels.toDF("_o", "_d"), most), "_o").select("_k", "_d", unknown)
        jump = labels.join(met(labels.toDF("_c", "_d"), most), "_c").select("_k", "_d", unknown)
        step = labels.select("_k", "_c", F.col("_c").alias("_was")).union(near).union(jump)
        new = saved(step.groupBy("_k").agg(F.min("_c").alias("_c"), F.max("_was").alias("_was")), most)
        labels = new.select("_k", "_c")
        if new.where("_c <> _was").isEmpty():
            return labels


def _classes(docs: DataFrame, similar: float) -> DataFrame:
    """(_id, _k, _first): the least (id, text hash) of the row's class; one row for each row."""
    bands = checkpointed(band_rows(docs))
    labels = linked(docs, bands, similar)
    members = bands.select("_id", "_k")
    named = members.withColumn("_c", F.col("_k")) if labels is None else members.join(labels, "_k", "left").select("_id", "_k", F.coalesce("_c", "_k").alias("_c"))
    return named.join(named.groupBy("_c").agg(F.min(F.struct("_id", "_k")).alias("_first"), F.count("_c").alias("_size")), "_c").select("_id", "_k", "_first", "_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_size`` of each document: classes are the connected components of links between texts.

    Equal texts are linked; so are texts whose multisets of five-word shingles (lower case, without ASCII punctuation) have a
    probability Jaccard similarity of ``similar`` or more, found where one of 20 bands of 4 registers agrees (a pair at 0.8 is
    missed with a chance of 3e-5). ``class_id`` is the least id. A text of fewer than five words is one shingle; texts without
    words (null: empty) are linked to equal texts only. Null ids count as the least and stay null; repeated rows are members of
    their own. Texts are told apart by a 64-bit hash. An empty table gives no rows.
    """
    return _classes(keyed(docs, id_col, text_col), similar).select(id_back().alias("doc_id"), id_back("_first._id").alias("class_id"), F.col("_size").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The documents, with all their columns, less all but the first of each class; of equal rows one stays."""
    kept = _classes(keyed(docs, id_col, text_col), similar).where("_id = _first._id AND _k = _first._k").select("_id", "_k").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_k"))
    return rows.join(kept, ["_id", "_k"]).withColumn("_n", F.row_number().over(W.partitionBy("_id", "_k").orderBy("_k"))).where("_n = 1").select("_row.*")
