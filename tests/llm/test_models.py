"""Language ID, toxicity and SentencePiece."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DATA, documents, edges, empty
from weftline.llm.language_id import DECLARED, SMOOTHING, SUFFIX, SUFFIXES, TEMPER, UNKNOWN, accepted_only, declared_in, domain_of, fitted, host_of, language_id, plain_text, sampled
from weftline.llm.sentencepiece_codec import MODEL, encode, round_trip, with_decoded
from weftline.llm.toxicity import fit, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a model of few rows of each language, judged by the documents that it has not seen
    model, seen = fitted(docs, rows=30), sampled(docs, "doc_id", "text", "lang", 30)
    assert seen.groupBy("_l").count().where("count > 30").isEmpty()
    got = docs.drop("source").join(seen.select(F.col("_text").alias("text")), "text", "left_anti").join(language_id(docs, model=model).withColumnRenamed("lang", "told"), "doc_id")
    assert got.count() > 0.8 * docs.count()
    assert got.agg(F.avg((F.col("lang") == F.col("told")).cast("int"))).first()[0] > 0.99
    assert accepted_only(docs).count() > 0.99 * docs.count() and accepted_only(docs).columns == docs.columns


def test_evidence_is_fused(spark):
    model = fitted(spark.createDataFrame([(1, "the cat and the dog are here with them", "en"), (2, "le chat et le chien sont dans la maison avec eux", "fr")], "doc_id long, text string, lang string"))
    rows = [(i, "the dog and the cat", f"http://a{i % 3}.site.com/x", "<html>") for i in range(60)]
    rows += [(100, "ok", "http://b.site.fr/x", '<html lang="fr">'), (101, "ok", "http://a1.site.com/", "<html class=x LANG='en'>"), (102, "ok", "https://u@c.org/fr/1", ""), (103, "", "http://a1.site.com/", ""), (104, "zzzz qqqq xxxx 漢字漢字漢字漢字漢字漢字", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, html string")
    got = {r.doc_id: r for r in language_id(docs, host_col=None, url_col="url", html_col="html", model=model).collect()}
    assert got[0].lang == "en" and got[100].lang == "fr" and got[101].lang == "en" and got[102].suffix == "fr"
    assert got[101].probability > 0.9 and not got[103].accepted and not got[104].accepted
    # the host's prior is the only evidence of an empty text, and follows its documents
    assert got[103].lang == "en"


def trigrams(text):
    """The buckets of the byte trigrams of a text, byte by byte."""
    data = [b if b >= 65 else 32 for b in text.lower().encode()] + [32]
    out = []
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if (b, c) != (32, 32):
            key = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
            out.append(((key ^ key >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
    return out


def test_posteriors_equal_bayes_by_hand(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("shown", plain_text(F.col("html")))
    docs = documents(spark)
    learned = fitted(docs, rows=10**6)
    counts = {}
    for r in docs.where("text <> ''").collect():
        own = counts.setdefault(r.lang, np.zeros(1 << 15))
        np.add.at(own, trigrams(r.text), 1)
    names = sorted(counts)
    assert learned.languages == names
    table = [counts[x] + min(0.05, counts[x].sum() / (2 << 15)) for x in names] + [np.ones(1 << 15)]
    logs = [np.log(t / t.sum()) for t in table]
    assert np.allclose(learned.log, logs, atol=1e-5)
    rows = pages.select("page_id", "shown", "url", "html", host_of(F.col("url")).alias("host"), domain_of(host_of(F.col("url"))).alias("domain"), declared_in(F.col("html")).alias("declared")).collect()
    ll = {r.page_id: [TEMPER * sum(t[b] for b in trigrams(r.shown)) for t in logs] for r in rows}
    hosts, domains, whole = {}, {}, np.ones(len(names))
    for r in rows:
        x = np.exp(np.array(ll[r.page_id][:-1]) - max(ll[r.page_id][:-1]))
        x = x / x.sum() if trigrams(r.shown) else np.zeros(len(names))
        for level, key in ((hosts, r.host), (domains, r.domain)):
            level[key] = level.get(key, 0) + x
        whole = whole + x
    got = {r.doc_id: r for r in language_id(pages, "page_id", "shown", None, "url", "html", model=learned).collect()}
    assert len(got) == len(rows) and any(r.declared for r in got.values()) and any(r.suffix for r in got.values())
    for r in rows:
        prior = whole / whole.sum()
        for sums in (domains[r.domain], hosts[r.host]):
            prior = (sums + SMOOTHING * prior) / (sums.sum() + SMOOTHING)
        first = r.url.split("://")[1].split("/")[1][:3].rstrip("/?#-")
        suffix = first if first in names else SUFFIXES.get(r.host.rsplit(".", 1)[1])
        weight = [a + np.log(p * (1 - UNKNOWN)) for a, p in zip(ll[r.page_id], prior, strict=False)]
        for told, right in ((r.declared, DECLARED), (suffix, SUFFIX)):
            if told in names:
                weight = [w + np.log(right if x == told else (1 - right) / (len(names) - 1)) for w, x in zip(weight, names, strict=True)]
        weight.append(ll[r.page_id][-1] + np.log(UNKNOWN))
        post = np.exp(np.array(weight) - max(weight))
        post = post / post.sum()
        best = int(post.argmax())
        assert got[r.page_id].lang == (names[best] if best < len(names) else None) and got[r.page_id].probability == pytest.approx(post[best], abs=1e-4)
        assert got[r.page_id].accepted == (best < len(names) and post[best] >= 0.5 and bool(trigrams(r.shown)))


def test_addresses(spark):
    row = spark.createDataFrame([("HTTP://me@News.Example.co.uk:80/a",), (None,), ("nothing",)], "u string").select(host_of(F.col("u")).alias("h"), domain_of(host_of(F.col("u"))).alias("d"), declared_in(F.lit("<HTML data-x='1' lang=de-DE>")).alias("l")).collect()
    assert [tuple(r) for r in row] == [("news.example.co.uk", "co.uk", "de"), (None, None, "de"), ("", "", "de")]


def test_language_edges(spark):
    got = language_id(edges(spark)).collect()
    assert len(got) == 12 and sum(r.doc_id is None for r in got) == 2
    assert not any(r.accepted for r in got if r.doc_id in (2, 3, 6))
    assert language_id(empty(spark)).count() == 0 and accepted_only(empty(spark)).count() == 0
    unlabelled = edges(spark).withColumn("lang", F.lit(None).cast("string"))
    assert not any(r.accepted for r in language_id(unlabelled).collect())


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, fit(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    bad, good = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    assert np.mean([[x > y for y in good] for x in bad]) > 0.75
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.where("false"), labels.where("toxic = 0")):
        got = toxicity(edges(spark), fit(edges(spark), own)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(empty(spark), fit(empty(spark), labels)).count() == 0


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (documents(spark), edges(spark)):
        for r in with_decoded(encode(df)).collect():
            assert r.piece_ids == library.encode(r.text or "")
            assert r.decoded == (r.text or "").replace("▁", " ")
    assert encode(edges(spark)).columns == [*edges(spark).columns, "piece_ids"]


def test_round_trip_edges(spark):
    got = round_trip(edges(spark)).collect()
    assert len(got) == 12 and [r.doc_id for r in got if not r.same] == [8]  # a text's own word mark becomes a space
    assert round_trip(empty(spark)).count() == 0
    assert all(r.same for r in round_trip(spark.read.parquet(f"{DATA}/documents.parquet")).collect())
    with pytest.raises(ValueError, match="piece_ids"):
        encode(edges(spark).withColumnRenamed("kept", "piece_ids"))


def test_best_paths_equal_all_segmentations():
    import random

    from weftline.llm.sentencepiece_codec import LONE, Encoder, Vocabulary

    random.seed(3)
    pieces = sorted({"".join(random.choices("abc▁", k=random.randrange(1, 5))) for _ in range(60)} | {"a", "b", "▁"})
    scores = [-random.random() * 9 - 0.5 for _ in pieces]
    encoder = Encoder(Vocabulary(pieces, {p: i for i, p in enumerate(pieces)}, scores, [0] * 256, [p.encode() for p in pieces], merges=False))

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for n in range(1, len(word) + 1):
            i = encoder.v.ids.get(word[:n])
            if i is not None or n == 1:
                score, rest = best(word[n:])
                found.append((score + (scores[i] if i is not None else encoder.least), [i if i is not None else LONE + ord(word[0]), *rest]))
        return max(found, key=lambda x: x[0])

    words = sorted({"▁" + "".join(random.choices("abcd", k=random.randrange(0, 9))) for _ in range(200)})
    for word, got in zip(words, encoder.best_paths(words), strict=True):
        # orders of the same pieces may tie
        assert "".join(map(encoder.text, got)) == word and sum(encoder.least if i >= LONE else scores[i] for i in got) == pytest.approx(best(word)[0])
    assert list(encoder.forward(words)) == list(encoder.best_paths(words))


def test_long_words_are_merged_like_the_librarys():
    import time

    import pyarrow as pa
    import sentencepiece

    from weftline.llm.sentencepiece_codec import Encoder, load

    library, encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(load())
    texts_ = ["abcdefghij" * 20_000, "x" * 300 + " and " + "z" * 65, "     " * 40 + "a", "漢字かな" * 500, "aa  b   c" * 50]
    begun = time.perf_counter()
    ids, at = encoder.encode(pa.array(texts_, pa.string()))
    assert time.perf_counter() - begun < 60
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts_)
