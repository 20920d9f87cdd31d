"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

Tokens are what single spaces part; those with digits, at signs or slashes are variable fields. The tree's inner nodes are the
number of tokens and the leading tokens. A leaf's template has its prevailing tokens, and variable fields at the other positions. Lines that
don't fit it, or all if too few tokens prevail, are split by their most decisive position, and each part has a template of its own, for a
fixed number of rounds. Unlike the sequential parser that the tree comes from, templates are a function of the lines, not of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, checkpointed, id_back, keyed
from weftline.llm.lookup import looked_up

FIELD = "<*>"
#: Leading tokens that the tree looks at, besides the number of tokens.
DEPTH = 3
#: A token prevails at its position if this share of a leaf's lines has it; a template needs this share of such positions.
PREVAILS, CONSTANT = 0.6, 0.5
#: Levels below a leaf: how often lines that fit no template are split by their most decisive position.
SPLITS = 2
#: Templates found in so many different texts recur; copies of one text are left to document dedup.
MIN_DOCS = 5


def masked(line: Column) -> Column:
    return F.regexp_replace(line, r"(?<![^ ])[^ 0-9@/]*+[0-9@/][^ ]*", FIELD)


def _leaf(line: Column) -> Column:
    """The tree's path: how many tokens, and the leading ones with their variable fields masked; the rest is not read."""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(n, masked(F.substring_index(line, " ", DEPTH)))


def _held(found: Column, item: Column) -> Column:
    """Whether a sorted array holds an item, by halving steps: what a line costs grows with the logarithm of its text's lines."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(31))))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((step <= F.size(found) - at) & (F.get(found, at + step - 1) <= item), at + step).otherwise(at))
    return F.coalesce(F.get(found, place - 1) == item, F.lit(False))


def _hashed(lines: Column, key) -> Column:
    return F.transform(lines, lambda s: F.struct(s.alias("line"), key(s).alias("key")))


def _of_all(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``looked_up`` with keys weighed against all rows, so that a line that very many documents share meets its key in every task."""
    return looked_up(rows, found, keys, weight, rows.count())


def recurring_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """(_id, _k, _lines): hashes of the lines of each ``keyed`` document whose template recurs."""
    lines = F.array_distinct(F.filter(F.split("_text", "\n"), lambda s: F.trim(s) != ""))
    leaves = checkpointed(docs.select("_id", "_k", F.explode(F.array_distinct(F.transform(lines, _leaf))).alias("_leaf")))
    shared = checkpointed(leaves.groupBy("_leaf").agg(F.count("_id").alias("_n")).where(F.col("_n") >= min_docs).withColumn("_shared", F.lit(True)))
    wanted = _of_all(leaves, shared, ["_leaf"], "_n").where("_shared").groupBy("_id", "_k").agg(F.sort_array(F.collect_set("_leaf")).alias("_leaves"))
    found = docs.join(wanted, ["_id", "_k"]).select("_id", "_k", F.explode(F.filter(_hashed(lines, _leaf), lambda x: _held(F.col("_leaves"), x["key"]))).alias("_own"))
    found = checkpointed(found.select("_id", "_k", F.col("_own.key").alias("_leaf"), masked(F.col("_own.line")).alias("_line"), F.xxhash64("_own.line").alias("_hash")))
    variants = checkpointed(found.groupBy("_leaf", "_line").agg(F.count("_id").alias("_n")))
    names = checkpointed(_named(variants))
    # a line of variable fields alone has no template: it is named by what it says
    named = _of_all(found, names, ["_leaf", "_line"], "_n").select("_id", "_k", F.coalesce("_name", F.xxhash64("_leaf", "_hash")).alias("_name"), "_hash")
    named = checkpointed(named)
    texts = named.groupBy("_k", "_name").agg(F.count("_k").alias("_n")).groupBy("_name").agg(F.count("_k").alias("_texts"), F.sum("_n").alias("_n"))
    recurring = checkpointed(texts.where(F.col("_texts") >= min_docs))
    return _of_all(named, recurring, ["_name"], "_n").where("_texts IS NOT NULL").groupBy("_id", "_k").agg(F.sort_array(F.collect_set("_hash")).alias("_lines"))


def _constant(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: t != FIELD)) >= CONSTANT * F.size(template)


def _named(variants: DataFrame) -> DataFrame:
    """(_leaf, _line, _name, _n) of masked lines (_leaf, _line, _n): the hash of the template that a line fits, or of the line itself; null
    if the line has too few tokens of its own for either.

    Each round takes the lines of a node that fit its template, if enough of its tokens are constant, and splits the others by the position
    that has fewest different tokens, but more than one.
    """
    rest, done = variants.select("_leaf", "_line", "_n", F.col("_leaf").alias("_node")), None
    for level in range(SPLITS + 1):
        tokens = rest.select("_node", "_n", F.posexplode(F.split("_line", " ")).alias("_i", "_token")).groupBy("_node", "_i", "_token").agg(F.sum("_n").alias("_n"))
        places = tokens.groupBy("_node", "_i").agg(F.max(F.struct("_n", "_token")).alias("_top"), F.sum("_n").alias("_all"), F.count("_n").alias("_kinds"))
        prevails = F.col("_top._n") >= PREVAILS * F.col("_all")
        place = F.when(prevails, F.col("_top._token")).otherwise(FIELD)
        decisive = F.min(F.when(~prevails, F.struct("_kinds", "_i")))["_i"]
        nodes = places.groupBy("_node").agg(F.sort_array(F.collect_list(F.struct("_i", place.alias("t")))).alias("_places"), decisive.alias("_by")).select("_node", F.transform("_places", lambda x: x["t"]).alias("_template"), "_by")
        own = F.split("_line", " ")
        fits = _constant(F.col("_template")) & F.forall(F.zip_with("_template", own, lambda t, x: (t == FIELD) | (t == x)), lambda x: x)
        last = level == SPLITS
        name = F.when(fits, F.xxhash64("_leaf", F.array_join("_template", " "))).when(_constant(own), F.xxhash64("_leaf", "_line"))
        judged = rest.join(nodes, "_node").select("_leaf", "_line", "_n", "_node", fits.alias("_fits"), name.alias("_name"), F.xxhash64("_node", "_by", F.get(own, F.coalesce("_by", F.lit(-1)))).alias("_next"))
        judged = judged if last else checkpointed(judged)
        ready = (judged if last else judged.where("_fits")).select("_leaf", "_line", "_name", "_n")
        done = ready if done is None else done.union(ready)
        rest = judged.where("NOT _fits").select("_leaf", "_line", "_n", F.col("_next").alias("_node"))
    return done


def _cut(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows with ``_id, _k, _text`` and ``_out``, the text without those lines."""
    kept = F.filter(_hashed(F.split("_text", "\n"), F.xxhash64), lambda x: ~_held(F.col("_lines"), x["key"]))
    return docs.join(lines, ["_id", "_k"], "left").withColumn("_out", F.when(F.col("_lines").isNotNull(), F.array_join(kept["line"], "\n")).otherwise(F.col("_text")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Drops from each document the lines whose template recurs in at least ``min_docs`` different texts.

    Returns ``doc_id, n_lines, n_dropped, text``. Blank lines stay. Lines go whatever share of the document they are; rows with
    one and the same text count once, so that a text's copies alone drop nothing. Null texts are empty (one empty line); null
    ids stay null; an empty table gives no rows.
    """
    source = keyed(docs, id_col, text_col)
    out = _cut(source, recurring_lines(source, min_docs))
    n = [F.size(F.split(c, "\n")).cast("long") for c in ("_text", "_out")]
    # a text whose lines are all dropped has none left
    left = F.when((F.col("_out") == "") & (F.col("_text") != ""), F.lit(0)).otherwise(n[1])
    return out.select(id_back().alias("doc_id"), n[0].alias("n_lines"), (n[0] - left).alias("n_dropped"), F.col("_out").alias("text"))


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, with all their columns, with such lines cut out of the text; ``length_col`` is set anew if there."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = recurring_lines(keyed(docs, id_col, text_col), min_docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_k"), text.alias("_text"))
    new = _cut(rows, lines)
    put = {text_col: F.col("_out")} | ({length_col: F.length("_out").cast("long")} if length_col in docs.columns else {})
    return new.select(*(put[c].alias(c) if c in put else F.col("_row")[c].alias(c) for c in docs.columns))
