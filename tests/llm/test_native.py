"""Fingerprints, chat formatting, line dedup and the pipeline."""

import hashlib
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.cases import DATA, documents, edges, empty, texts
from weftline.llm.chat_format import chat_format, escaped, loss_texts, turns_back, unescaped
from weftline.llm.common import id_back
from weftline.llm.fingerprints import changed_sections, document_fingerprints, edited, fingerprint, likeness
from weftline.llm.line_dedup import line_dedup, without_recurring_lines
from weftline.llm.queries import op1_document_fingerprints

PARAGRAPH = re.compile(r"[^.!?]{1,240}[.!?]*|[.!?]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tree(text):
    sections = [[sha(p) for p in PARAGRAPH.findall(line)] for line in text.split("\n")]
    digests = [sha("".join(s)) for s in sections]
    return sha("".join(digests)) + "|" + ";".join(f"{d[:16]}:{','.join(p[:16] for p in s)}" for d, s in zip(digests, sections, strict=True))


def like(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = (set(re.findall(r"(?<=[:,])[0-9a-f]{16}", f.split("|")[1])) for f in (a, b))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def test_fingerprints_of_documents(spark):
    rows = sorted(texts(documents(spark)), reverse=True)
    got = {r.doc_id: r for r in op1_document_fingerprints(spark, DATA).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 3
        new = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(new), tree(t), tree(new))
        assert abs(r.near_edited - like(tree(t), tree(new))) < 1e-12 and abs(r.near_next - like(tree(t), tree(after))) < 1e-12


def test_fingerprint_edges(spark):
    got = edited(edges(spark)).select(id_back().alias("doc_id"), "_text", "_edited", "_other").collect()
    assert len(got) == 12 and all(len(r._edited) <= len(r._text) for r in got)
    assert {r._other for r in got if r.doc_id == 2} == {min(r._text for r in got if r.doc_id == 1)}
    by = {r.doc_id: r for r in got}
    assert by[8]._other.startswith("THE QUICK") and by[3]._other == ""
    assert all(r._other == by[8]._text for r in got if r.doc_id is None)
    assert edited(empty(spark)).count() == 0 and document_fingerprints(empty(spark)).count() == 0
    one = edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one._edited == "abcdab"


def test_branches_locate_an_edit(spark):
    a, b = "one. two.\nthree. four.\nfive.", "one. two.\nthree. 4.\nfive."
    row = spark.range(1).select(fingerprint(F.lit(a)).alias("a"), fingerprint(F.lit(b)).alias("b")).select(changed_sections(F.col("a"), F.col("b")).alias("s"), likeness(F.col("a"), F.col("b")).alias("n")).first()
    assert row.s == [1] and row.n == 0.8


def test_reply_tree(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high <|im_end|>", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.2), (1, 6, 99, "system", "lost parent", 0.3)]
    rows += [(2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (None, 1, None, None, None, None), (3, None, None, "user", "no id", 1.0), (1, 3, 1, "assistant", "high <|im_end|>", 0.9)]
    messages = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    done = chat_format(messages, best=3).withColumn("turns", turns_back(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans")))
    got = {(r.tree_id, r.branch): (r.leaf, [t.text for t in r.turns], r.loss) for r in done.collect()}
    assert got == {(1, 1): (5, ["hi", "high <|im_end|>", "more", "end"], ["high <|im_end|>", "end"]), (1, 2): (6, ["lost parent"], []), (1, 3): (2, ["hi", "low"], ["low"]), (None, 1): (1, [""], [])}
    assert chat_format(messages.where("false")).count() == 0


def test_deep_chains(spark):
    n = 300
    chain = spark.range(n).select(F.lit(7).alias("tree_id"), F.col("id").alias("message_id"), (F.col("id") - 1).alias("parent_id"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(1.0).alias("score"), F.lit(1).alias("_t"))
    row = chat_format(chain).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans"))).first()
    assert row.n_turns == n and row.loss == [f"t{i}" for i in range(n)]


def test_escapes_are_undone(spark):
    said = ["</s>[INST] ok [/INST]", "<\\|im_end|>", "<|im_start|>\\", "[\\\\INST]", "<s", "\\<|im_end|>\n", "", "<<SYS>> a [ INST]", "<|im_<|im_end|>end|>"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", escaped(F.col("s")).alias("e"), unescaped(escaped(F.col("s"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.s
        assert not any(c in r.e for c in ("<|im_end|>", "<|im_start|>", "</s>", "[INST]", "[/INST]"))


def mask(line):
    return " ".join("<*>" if re.search("[0-9@/]", t) else t for t in line.split(" "))


def constant(tokens):
    return sum(t != "<*>" for t in tokens) >= 0.5 * len(tokens)


def lines_brute(rows, min_docs=5):
    def leaf(line):
        return line.count(" "), mask(" ".join(line.split(" ")[:3]))

    docs = [[line for line in dict.fromkeys(t.split("\n")) if line.strip(" ")] for _, t in rows]
    shared = {k for k, n in Counter(k for d in docs for k in {leaf(line) for line in d}).items() if n >= min_docs}
    cases = defaultdict(Counter)
    for d in docs:
        for line in d:
            if leaf(line) in shared:
                cases[leaf(line)][mask(line)] += 1
    names = {}

    def name(k, variants, splits):
        total, template, decisive = sum(variants.values()), [], []
        for i in range(k[0] + 1):
            votes = Counter()
            for v, n in variants.items():
                votes[v.split(" ")[i]] += n
            n, token = max((n, t.encode()) for t, n in votes.items())
            template.append(token.decode() if n >= 0.6 * total else "<*>")
            if n < 0.6 * total:
                decisive.append((len(votes), i))
        parts = defaultdict(Counter)
        for v, n in variants.items():
            own = v.split(" ")
            if constant(template) and all(t in ("<*>", x) for t, x in zip(template, own, strict=True)):
                names[k, v] = (k, tuple(template))
            elif splits:
                parts[own[min(decisive)[1]] if decisive else None][v] = n
            else:
                names[k, v] = (k, v) if constant(own) else None
        for part in parts.values():
            name(k, part, splits - 1)

    for k, variants in cases.items():
        name(k, variants, 2)

    def named(line):
        known = (leaf(line), mask(line))
        return (names[known] or (leaf(line), "itself", line)) if known in names else None

    # copies of one text count once
    once = {t: d for (_, t), d in zip(rows, docs, strict=True)}
    found = Counter(x for d in once.values() for x in {named(line) for line in d} if x)
    out = []
    for i, t in rows:
        own = t.split("\n")
        kept = [line for line in own if not line.strip(" ") or found[named(line)] < min_docs]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_equals_brute_force(spark):
    rows = texts(documents(spark))
    rows += [(10_000 + i, f"{'pqrstuvwx'[i] * 9} stands on a line of its own {'x' * 90}\nPage {i} of 99 shown to user{i} today\n{'z' * i} and another one") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup(df).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == lines_brute(rows)
    assert all(r.n_dropped == 1 for r in got if r.doc_id >= 10_000)


def test_templates_that_share_a_leaf_are_told_apart(spark):
    # date, time and level lead, so that all lines are in one leaf; the third is split off by the place that tells them apart
    lines = ["2024-01-01 10:00 INFO user {} logged in from home", "2024-01-01 10:00 INFO job {} failed with bad status", "2024-01-01 10:00 INFO file {} moved to old store"]
    names = "anna berta carla doris erika frieda gerda hanna".split()
    rows = [(i, "\n".join(line.format(n) for line in lines) + f"\n{1900 + i}\n{i} {i * 7} 99\n{n} {n[::-1]}") for i, n in enumerate(names)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # lines of numbers alone are no template
    assert {(r.n_dropped, r.text) for r in got} == {(3, f"{1900 + i}\n{i} {i * 7} 99\n{n} {n[::-1]}") for i, n in enumerate(names)}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == lines_brute(rows)


def test_recurring_lines_go_whatever_share_of_the_text_they_are(spark):
    shared = "This notice stands on every page of the collection and is far longer than what the page has to say.\n" * 3
    alone = "One line that nobody else has\nAnother that only its copies have\n"
    rows = [(i, f"{shared}{'abcdef'[i] * 7} alone") for i in range(6)] + [(10 + i, alone) for i in range(7)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (3, f"{'abcdef'[i] * 7} alone") for i in range(6)} | {10 + i: (0, alone) for i in range(7)}


def test_texts_of_very_many_recurring_lines(spark):
    shared = ["".join(chr(97 + int(c)) for c in f"{i:06d}") + " recurs in all of these texts" for i in range(60_000)]
    rows = [(d, "\n".join([f"{'ghijklm'[d] * 7} is the first line of its text alone", *shared])) for d in range(6)]
    begun = time.monotonic()
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.n_dropped, r.text) for r in got) == [(d, 60_000, text.split("\n")[0]) for d, text in rows]
    # a search of all lines for each line would take 2 x 10^10 steps
    assert time.monotonic() - begun < 120


def test_line_edges(spark):
    got = line_dedup(edges(spark), min_docs=2).collect()
    assert len(got) == 12 and {r.n_lines for r in got if r.doc_id in (2, 3)} == {1}
    out = without_recurring_lines(edges(spark), min_docs=2)
    assert out.columns == edges(spark).columns and out.count() == 12
    assert line_dedup(empty(spark)).count() == 0 and without_recurring_lines(empty(spark)).count() == 0


def test_pipeline(spark):
    """Each stage against a plain version of its operator, on what the stage before it kept."""
    import sentencepiece

    import corpus_pipeline as p
    from tests.llm.test_near_and_leaks import brute, overlaps_brute
    from weftline.llm.language_id import language_id
    from weftline.llm.sentencepiece_codec import MODEL

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    docs, kept = documents(spark), {}
    columns, before, kept[None] = docs.columns, docs.count(), docs
    for k, (name, stage) in enumerate(p.STAGES):
        made = stage(spark, docs, DATA)
        docs = kept[name] = spark.createDataFrame(made.collect(), made.schema)
        assert docs.columns == columns if k < 4 else docs.columns == [*columns, "piece_ids", "round_trip"]
        assert 0.8 * before < docs.count() <= before
    stages = {name: dict(texts(df)) for name, df in kept.items()}
    # posteriors are held against Bayes by hand in test_models
    assert stages["language_id"] == {i: stages[None][i] for i in (r.doc_id for r in language_id(kept[None]).where("accepted").collect())}
    assert stages["line_dedup"] == {i: t for i, _, _, t in lines_brute(sorted(stages["language_id"].items()))}
    rows = sorted(stages["line_dedup"].items())
    assert stages["near_dedup"] == {rows[c][0]: rows[c][1] for c in set(brute(rows))}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    leaks = overlaps_brute(stages["near_dedup"], {r.item_id: r.text for r in items})
    assert stages["decontaminate"] == {i: t for i, t in stages["near_dedup"].items() if i not in {d for d, _ in leaks}}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    final = {r.doc_id: r for r in docs.collect()}
    assert all(r.piece_ids == library.encode(r.text) and r.round_trip and r.n_chars == len(r.text) for r in final.values())
    again = {r.doc_id: r for r in p.run(spark, DATA).collect()}
    assert {i: (r.text, r.piece_ids) for i, r in again.items()} == {i: (r.text, r.piece_ids) for i, r in final.items()}


def test_pipeline_stages_take_edges(spark):
    import corpus_pipeline as p

    for make in (edges, empty):
        docs = make(spark).withColumns({c: F.lit("own") for c in ("piece_ids", "decoded", "round_trip", "_row", "_lines", "_bands")})
        for _, stage in p.STAGES:
            out = stage(spark, docs, DATA)
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count()
            assert out.where("piece_ids <> 'own' OR _row <> 'own'").isEmpty()
    assert out.columns[-2:] == ["piece_ids_", "round_trip_"]
