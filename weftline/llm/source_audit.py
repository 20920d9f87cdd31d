"""How the vocabularies of sources differ: Gustavson's row-by-row accumulation over a term-major index of counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import saved
from weftline.llm.lookup import looked_up

#: A term is a run of ASCII letters and of characters beyond ASCII: in UTF-8, of these bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A language keeps the terms in so many of its documents.
LEAST = 10
#: Shares are parts of so many.
PARTS = 1_000_000_000
#: Entries that a task counts before it hands them on.
ENTRIES = 200_000
#: Postings in a block of the index, about, cells of the table of sources that a task returns at most (but always a row), and values that it
#: works on at a time.
BLOCK, CELLS, STEP = 100_000, 1_000_000, 500_000
RANKS = 10


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that have it, over all texts.

    Tasks count what they read before the shuffle, so that a frequent term or a large source is a few rows for each task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in said.items():
                terms = list(n)
                arrays = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            said.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs = said.setdefault((lang, source), (Counter(), Counter()))
                found = TERM.findall(text.as_buffer().to_pybytes().lower())
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in said.values()) > ENTRIES:
                yield from handed()
        yield from handed()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = read.mapInArrow(rows, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, lang_n): the counts of kept terms, with the language's own count; a term's rows are one for each source."""
    term = W.partitionBy("lang", "term")
    both = counts.withColumn("_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
    return both.where(F.col("_docs") >= least).select("lang", "source", "term", "n", "lang_n")


def share(n, total, terms, div=lambda a, b: F.call_function("div", a, b)):
    """1 + floor(PARTS * (n + 2) / (total + 2 * terms)), three digits at a time, so that no product leaves 64 bits (up to 9e15 terms)."""
    whole = total + 2 * terms
    part, rest = div(n + 2, whole), (n + 2) % whole
    for _ in range(3):
        part, rest = part * 1000 + div(rest * 1000, whole), (rest * 1000) % whole
    return part + 1


def gap(p, q, div=lambda a, b: F.call_function("div", a, b)):
    """floor((p - q)^2 / (p + q))."""
    return div((p - q) * (p - q), p + q)


def whole_div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a // b


def accumulated(index: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, source, item, value) of one block: what its terms, and in block 0 the terms that neither has, add to each pair of sources.

    ``index`` has the block's postings (source, term, n), ``groups`` all sources of the language (source, total, terms); the sources
    of this ``part`` are the rows. A row starts from what every peer would have without the block's terms (all counts 0), adds what
    its own terms and each peer's change against that, and then goes through the index: for each of its terms, the term's postings
    are scattered into the dense row, to put right the terms that both have.
    """
    one = groups.slice(0, 1).to_pylist()[0]
    groups = groups.sort_by("source")
    names, total = groups.column("source").combine_chunks(), groups.column("total").to_numpy().astype(np.int64)
    n_sources, terms = len(names), np.int64(one["terms"])
    zero = share(np.zeros(n_sources, np.int64), total, terms, whole_div) if terms else np.ones(n_sources, np.int64)
    far = lambda p, q: gap(p, q, whole_div)
    place = {s: i for i, s in enumerate(names.to_pylist())}
    source = np.array([place[s] for s in index.column("source").to_pylist()], np.int64)
    term = index.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(source) else np.zeros(0, np.int64)
    p = share(index.column("n").to_numpy().astype(np.int64), total[source], terms, whole_div) if len(source) else np.zeros(0, np.int64)
    # the term-major index: postings in order of term, and where each term's begin
    order = np.argsort(term, kind="stable")
    peers, q = source[order], p[order]
    begins = np.searchsorted(term[order], np.arange(term.max() + 2 if len(term) else 1))
    # the rows: postings in order of source; equal shares of a source are one entry with their number
    order = np.lexsort((p, source))
    row_source, row_term, row_p = source[order], term[order], p[order]
    ends = np.searchsorted(row_source, np.arange(n_sources + 1))
    new = np.flatnonzero(np.concatenate(([True], (row_source[1:] != row_source[:-1]) | (row_p[1:] != row_p[:-1])))) if len(source) else np.zeros(0, np.int64)
    some_source, some_p, some_n = row_source[new], row_p[new], np.diff(np.append(new, len(source)))
    some_ends = np.searchsorted(some_source, np.arange(n_sources + 1))
    filled, n_own = np.flatnonzero(np.diff(some_ends)), np.diff(ends)

    out: list[tuple[np.ndarray, np.ndarray]] = []
    rows = range(one["part"], n_sources, one["parts"])
    for g in rows:
        none = far(zero[g], zero)
        acc = none * terms if one["block"] == 0 else np.zeros(n_sources, np.int64)
        acc -= (n_own[g] + n_own) * none
        a, b = some_ends[g], some_ends[g + 1]
        for i in range(a, b, max(1, STEP // n_sources)):
            j = min(b, i + max(1, STEP // n_sources))
            acc += (far(some_p[i:j, None], zero[None, :]) * some_n[i:j, None]).sum(0)
        if len(filled):
            acc[filled] += np.add.reduceat(some_n * far(some_p, zero[g]), some_ends[filled])
        a, b = ends[g], ends[g + 1]
        reach = np.cumsum(begins[row_term[a:b] + 1] - begins[row_term[a:b]])
        while a < b:
            # as many terms as have about STEP postings
            used = reach[a - ends[g] - 1] if a > ends[g] else 0
            c = min(b, ends[g] + max(int(np.searchsorted(reach, used + STEP)), a - ends[g] + 1))
            sizes = begins[row_term[a:c] + 1] - begins[row_term[a:c]]
            at = np.repeat(begins[row_term[a:c]] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            own, peer, theirs = np.repeat(row_p[a:c], sizes), peers[at], q[at]
            np.add.at(acc, peer, far(own, theirs) - far(own, zero[peer]) - far(zero[g], theirs) + none[peer])
            a = c
        acc[g] = 0
        out.append((np.full(n_sources, g), acc))
    row = np.concatenate([r for r, _ in out]) if out else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in out]) if out else np.zeros(0, np.int64)
    item = np.tile(np.arange(n_sources), len(out))
    keep = (row != item) & ((value != 0) | (one["block"] == 0))
    return pa.table({"lang": pa.array([one["lang"]] * int(keep.sum()), pa.string()), "source": names.take(pa.array(row[keep])), "item": names.take(pa.array(item[keep])), "value": pa.array(value[keep], pa.int64())})


def source_audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its other sources (part ``pair``, all ranks)
    and which terms it has more of than the language (part ``term``, ``ranks`` of them).

    Null texts, languages and sources are empty ones; a source without terms has the shares of counts of 0; a language without kept
    terms has pairs of value 0; repeated rows count as often as they are there; ties go by item in order of UTF-8; ids and further columns don't matter;
    an empty table gives no rows. All arithmetic is in whole numbers.
    """
    index = saved(postings(term_counts(docs, lang_col, source_col, text_col), least))
    spoken = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sums = index.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("_weight"))
    words = index.groupBy("lang", "term").agg(F.max("lang_n").alias("_n"), F.count("*").alias("_c"))
    langs = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("_n").alias("lang_total"), F.sum("_c").alias("_postings"))
    whole = spoken.groupBy("lang").agg(F.count("*").alias("_sources")).join(langs, "lang", "left")
    ceiling = lambda a, b: F.greatest(F.ceil(a / b), F.lit(1)).cast("long")
    sized = whole.select("lang", zero("terms"), zero("lang_total"), ceiling(F.coalesce("_postings", F.lit(0)), BLOCK).alias("blocks"), ceiling(F.col("_sources") * F.col("_sources"), CELLS).alias("parts"))
    groups = saved(spoken.join(sums, ["lang", "source"], "left").join(sized, "lang").select("lang", "source", zero("total"), zero("_weight"), "terms", "lang_total", "blocks", "parts"))

    facts = looked_up(index, groups, ["lang", "source"], "_weight", groups.agg(F.sum("_weight")).first()[0] or 0)
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = facts.select("lang", "source", F.col("term").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q").select("lang", "source", "item", gap(F.col("_p"), F.col("_q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = over.withColumn("rank", place).where(F.col("rank") <= ranks)

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = facts.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), every("parts").alias("part"), "source", "term", "n")
    right = groups.select("*", every("blocks").alias("block")).select("*", every("parts").alias("part"))
    keys = ["lang", "block", "part"]
    added = left.groupBy(*keys).cogroup(right.select(*keys, "parts", "source", "total", "terms").groupBy(*keys)).applyInArrow(accumulated, "lang string, source string, item string, value long")
    pairs = added.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", place)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(top.withColumn("part", F.lit("term")).select(*cols))
