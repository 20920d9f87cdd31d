"""Language identification by Bayesian fusion of text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, checkpointed, chunks, utf8

#: The text model is fitted on the whole texts of at most so many labelled rows of each language, those of least hash.
TRAIN_ROWS = 1500
#: So many rows of a language and a bound are few enough for every task.
FEW_LANGUAGES = 10_000
BUCKETS = 1 << 15
#: Trigrams of a text depend on each other; their log-likelihoods count as this share of independent ones.
TEMPER = 0.25
#: How often a declared language or an address suffix is right.
DECLARED, SUFFIX = 0.9, 0.8
#: Documents that a parent's prior is worth at the level below: the whole corpus for a domain, a domain for a host.
SMOOTHING = 20.0
#: Prior of the background, a text in none of the languages.
UNKNOWN = 0.01
#: Address suffixes that tell of a language: fixed values.
SUFFIXES = {"uk": "en", "us": "en", "ie": "en", "au": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh"}


def _trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of the lower-case texts that are joined by a space, and where each text starts."""
    col = pc.binary_join_element_wise(pc.utf8_lower(col.fill_null("")), pa.scalar(""), " ")
    data, at = utf8(col)
    x = data.astype(np.uint32)
    x[x < 65] = 32  # digits, punctuation and white space
    key = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35)) if len(x) > 2 else np.zeros(0, np.uint32)
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    keep = (x[1:-1] != 32) | (x[2:] != 32) if len(x) > 2 else np.zeros(0, bool)
    edge = np.concatenate((at[1:] - 1, at[1:] - 2))  # trigrams that run into the next text
    keep[edge[(edge >= 0) & (edge < len(keep))]] = False
    bucket = np.where(keep, (key >> np.uint32(17)).astype(np.int32), -1)
    return bucket, at


class TextModel:
    """Naive Bayes over hashed byte trigrams; one column of log-probabilities for each language and one for the background."""

    def __init__(self, counts: dict[str, np.ndarray]):
        """``counts``: for each language how often each bucket's trigrams occur."""
        self.languages = sorted(counts)
        table = np.zeros((len(self.languages) + 1, BUCKETS))
        for i, lang in enumerate(self.languages):
            # what stands for unseen trigrams never outweighs half of those seen, else a little text could not be told from the background
            table[i] = counts[lang] + min(0.05, max(1.0, counts[lang].sum()) / (2 * BUCKETS))
        table[-1] = 1.0
        self.log = np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).astype(np.float32))

    def likelihoods(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (rows x languages and background) and the number of trigrams of each row."""
        bucket, at = _trigrams(col)
        low, high = np.minimum(at[:-1], len(bucket)), np.minimum(at[1:], len(bucket))
        used = np.concatenate(([0], np.cumsum(bucket >= 0)))
        place = np.maximum(bucket, 0)
        out = np.empty((len(col), len(self.log)))
        for i, table in enumerate(self.log):
            total = np.concatenate(([0.0], np.cumsum(np.where(bucket >= 0, table[place], 0.0), dtype=np.float64)))
            out[:, i] = TEMPER * (total[high] - total[low])
        return out, used[high] - used[low]


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(_l, _text): the ``rows`` labelled texts of least hash of id and text of each language, whole; all of a rarer language.

    Each language is counted first, and only hashes below a bound that about twice as many of its rows meet are ranked, so that no
    task ranks a whole language.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    labelled = docs.where(lang.isNotNull() & (F.length(text) > 0)).select(lang.alias("_l"), text.alias("_text"), F.xxhash64(F.col(id_col), text).alias("_h"))
    bound = F.when(F.col("_n") > 2 * rows, -(2.0**63) + (2 * rows / F.col("_n")) * 2.0**64).otherwise(2.0**63)
    bounds = checkpointed(labelled.groupBy("_l").agg(F.count("_h").alias("_n")).select("_l", bound.alias("_below")))
    # a row for each language, counted: the texts are not moved before most are left out
    low = labelled.join(F.broadcast(bounds) if bounds.count() <= FEW_LANGUAGES else bounds, "_l").where(F.col("_h").cast("double") <= F.col("_below"))
    least = F.row_number().over(W.partitionBy("_l").orderBy("_h", "_text"))
    return low.withColumn("_r", least).where(F.col("_r") <= rows).select("_l", "_text")


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Fits the text model on the bounded sample of ``sampled``. Trigrams are counted in the tasks; the driver gets one row for each
    language and bucket, whatever the size of the corpus."""

    def counted(batches):
        for batch in chunks(batches):
            langs = batch.column(batch.schema.get_field_index("_l")).dictionary_encode()
            bucket, at = _trigrams(batch.column(batch.schema.get_field_index("_text")))
            own = np.repeat(langs.indices.to_numpy(), np.diff(at))[: len(bucket)].astype(np.int64)
            key, n = np.unique(own[bucket >= 0] * BUCKETS + bucket[bucket >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // BUCKETS)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(n)], ["_l", "_b", "_n"])

    found = sampled(docs, id_col, text_col, lang_col, rows).mapInArrow(counted, "_l string, _b int, _n long")
    table = found.groupBy("_l", "_b").agg(F.sum("_n").alias("_n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    langs = table["_l"].combine_chunks().dictionary_encode()
    bucket, n = table["_b"].to_numpy(), table["_n"].to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        mine = langs.indices.to_numpy() == i
        counts[lang] = np.bincount(bucket[mine], weights=n[mine], minlength=BUCKETS)
    return TextModel(counts)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; the host itself if it has fewer."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def declared_in(html: Column) -> Column:
    """The language that the markup declares, by the lang attribute of its html element."""
    return F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1))


def plain_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles, tags and entities."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_replace(shown, r"&#?[A-Za-z0-9]+;", " ")


def _told(col: str, names: list[str], right: float) -> Column:
    """The log-likelihood of what a column tells for each language, and for the background; null tells nothing."""
    wrong = F.lit((1 - right) / max(1, len(names) - 1))
    known = F.col(col).isin(names)
    return F.concat(F.transform(F.array(*[F.lit(x) for x in names]), lambda x: F.when(known, F.log(F.when(x == F.col(col), F.lit(right)).otherwise(wrong))).otherwise(F.lit(0.0))), F.array(F.lit(0.0)))


def _smoothed(counts: str, parent: Column) -> Column:
    """A level's prior: its own sums and SMOOTHING documents of its parent's prior."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + SMOOTHING
    return F.zip_with(counts, parent, lambda own, p: (own + SMOOTHING * p) / total)


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", url_col: str | None = None, html_col: str | None = None, lang_col: str = "lang", model: TextModel | None = None, at_least: float = 0.5
) -> DataFrame:
    """``doc_id, lang, probability, declared, suffix, n_trigrams, accepted`` and ``_k`` for each document.

    The text's tempered trigram likelihood, the language that the markup declares (``html_col``), the one that the address's
    suffix or first path part names (``url_col``) and the host's prior are multiplied. A host's prior comes from the text-only
    posteriors of its documents, smoothed towards its domain's, and that towards the whole corpus's; each level is one grouped
    sum. ``host_col`` names the host or, without it, the address does. ``lang`` is the likeliest language, null if the background
    is likelier; a document is accepted if its language has probability ``at_least`` and its text at least one trigram with a
    letter. Without a ``model``, one is fitted on a bounded sample of the rows with ``lang_col`` (see ``sampled``); with no such rows
    nothing is accepted. Null hosts share one prior; null or empty texts have no evidence of their own and are not accepted; repeated rows
    give repeated results; an empty table gives no rows.
    """
    model = model or fitted(docs, id_col, text_col, lang_col)
    names, count = model.languages, len(model.languages)
    none = F.lit(None).cast("string")
    url = F.col(url_col).cast("string") if url_col else none
    host = F.col(host_col).cast("string") if host_col else host_of(url)
    end = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    suffix = F.when(path.isin(names), path).otherwise(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[end])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    declared = F.nullif(declared_in(F.col(html_col)), F.lit("")) if html_col else none
    read = docs.select(F.col(id_col).cast("long").alias("_i"), F.xxhash64(text).alias("_k"), text.alias("_text"), F.coalesce(host, F.lit("")).alias("_host"), declared.alias("_declared"), suffix.alias("_suffix"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x languages

    def rows(batches):
        for batch in chunks(batches):
            ll, n = shared.value.likelihoods(batch.column(batch.schema.get_field_index("_text")))
            alone = np.exp(ll[:, :-1] - ll[:, :-1].max(1, keepdims=True)) if ll.shape[1] > 1 else ll[:, :0]
            alone = np.where(n[:, None] > 0, alone / np.maximum(alone.sum(1, keepdims=True), 1e-300), 0.0)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(x.shape[0] + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (ll, alone)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("_i", "_k", "_host", "_declared", "_suffix")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n.astype(np.int64)), *lists], ["_i", "_k", "_host", "_declared", "_suffix", "_n", "_ll", "_alone"])

    schema = "_i long, _k long, _host string, _declared string, _suffix string, _n long, _ll array<double>, _alone array<double>"
    scored = checkpointed(read.mapInArrow(rows, schema)).withColumn("_domain", domain_of(F.col("_host")))
    if not names:
        return scored.select(F.col("_i").alias("doc_id"), none.alias("lang"), F.lit(0.0).alias("probability"), F.col("_declared").alias("declared"), F.col("_suffix").alias("suffix"), F.col("_n").alias("n_trigrams"), F.lit(False).alias("accepted"), "_k")

    def summed(col: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.col(col)[i]), F.lit(0.0)) for i in range(count)])

    # one pass over the documents; the levels above are sums of its few rows
    hosts = checkpointed(scored.groupBy("_domain", "_host").agg(summed("_alone").alias("_s")))
    whole = np.array(hosts.agg(summed("_s").alias("_s")).first()[0]) + 1.0
    corpus = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])
    domains = hosts.groupBy("_domain").agg(summed("_s").alias("_d")).select("_domain", _smoothed("_d", corpus).alias("_dp"))
    prior = F.transform(_smoothed("_s", F.col("_dp")), lambda p: F.log(p * (1 - UNKNOWN)))
    priors = hosts.join(domains, "_domain").select("_host", F.concat(prior, F.array(F.lit(float(np.log(UNKNOWN))))).alias("_prior"))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    weights = plus(plus(F.col("_ll"), F.col("_prior")), plus(_told("_declared", names, DECLARED), _told("_suffix", names, SUFFIX)))
    # sums over arrays: the plan stays as small for many languages, and what is filtered later is no copy of it for each
    found = scored.join(priors, "_host").select("_i", "_k", "_n", "_declared", "_suffix", weights.alias("_w"))
    found = found.withColumn("_top", F.array_max("_w"))
    chance = 1 / F.aggregate("_w", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    best = F.array_position("_w", F.col("_top")).cast("int")
    named = F.when(best <= count, F.element_at(F.array(*[F.lit(x) for x in names], F.lit("")), best))
    found = found.select(F.col("_i").alias("doc_id"), named.alias("lang"), chance.alias("probability"), F.col("_declared").alias("declared"), F.col("_suffix").alias("suffix"), F.col("_n").alias("n_trigrams"), "_k")
    return found.withColumn("accepted", F.col("lang").isNotNull() & (F.col("probability") >= at_least) & (F.col("n_trigrams") > 0))


def accepted_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, that language_id accepts.

    Null and empty texts, and texts without a letter, go; null ids, ties and repeated rows are judged by their text and all their copies
    stay or go alike; further columns of any name are kept; an empty table gives no rows.
    """
    good = language_id(docs, id_col, text_col, **how).where("accepted").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_k").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_k"))
    return rows.join(good, ["_id", "_k"], "left_semi").select("_row.*")
