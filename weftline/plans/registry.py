"""Where queries are registered, with the tables they read and the parts that their SQL has in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import segments
from weftline.plans.policy import RULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Thresholds for lexical scores, which are lower than a model's.
LOW, HIGH = 0.2, 0.55
#: Decay of 36 hours in milliseconds, and the walk depth of the default policy.
SCALE, DEPTH = 36 * 3_600_000.0, RULES["recall.depth"].default


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.from_messages(table(spark, sf_dir, "conversations"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.from_events(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


WIDE = "[^㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"
TOKENS = f"greatest(1, CAST(ceil(length(regexp_replace({{0}}, '{WIDE}', '', 'g')) + (length({{0}}) - length(regexp_replace({{0}}, '{WIDE}', '', 'g'))) / 4.0) AS BIGINT))"
SETS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1))"
SEG = f"""seg AS (
  SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, trim(text)) - 1 AS idx, turn AS seq,
    CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'tool' THEN 'toolResult' ELSE 'systemPinned' END AS kind, role, trim(text) AS text, {TOKENS.format("trim(text)")} AS tokens
  FROM conversations WHERE length(trim(text)) > 0)"""
OVERLAP = "CASE WHEN least(len(a.s), len(b.s)) > 0 THEN len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)) ELSE 0.0 END"
LEX = f"""toks AS (SELECT *, {SETS.format("text")} AS s FROM seg),
lex AS (SELECT b.session, a.idx AS from_idx, b.idx AS to_idx, {OVERLAP} AS w FROM toks a JOIN toks b ON a.session = b.session AND a.idx BETWEEN b.idx - 16 AND b.idx - 1)"""
PLACE = """free AS (SELECT *, row_number() OVER (PARTITION BY session, kind <> 'systemPinned' ORDER BY idx DESC) AS r FROM seg),
placed AS (SELECT *, CASE WHEN kind = 'systemPinned' THEN 'pinned' WHEN r = 1 THEN 'anchor' WHEN r <= 4 THEN 'tail' ELSE 'history' END AS place FROM free)"""
EV = """ev AS (SELECT user_id AS session, event_id, epoch_us(ts) // 1000 AS ts, event_type, value, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS topic,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS idx FROM events)"""
TOPIC = """sc AS (SELECT b.session, a.idx AS from_idx, b.idx AS to_idx, b.ts AS born,
  CASE WHEN a.topic = b.topic THEN 0.9::DOUBLE - 0.02::DOUBLE * (b.idx - a.idx - 1) ELSE 0.5::DOUBLE / (1 + abs(a.topic - b.topic)) END AS w
  FROM ev a JOIN ev b ON a.session = b.session AND a.idx BETWEEN b.idx - 16 AND b.idx - 1)"""


def walk_sql(depth: int) -> str:
    """The walk level by level, as SQL has no loop that looks at all that was reached before: r0 to r<depth>, hits and weights."""
    out = """seed AS (SELECT session, max(idx) AS idx, max(ts) AS newest FROM ev GROUP BY session),
arc AS (SELECT sc.session, to_idx, from_idx, w * exp(-greatest(0.0, newest - born) / 129600000.0) AS e FROM sc JOIN seed ON seed.session = sc.session WHERE w * exp(-greatest(0.0, newest - born) / 129600000.0) > 0.55),
r0 AS (SELECT session, idx, 0 AS depth, CAST(NULL AS BIGINT) AS via, 1 AS pos FROM seed), u0 AS (SELECT * FROM r0)"""
    for k in range(1, depth + 1):
        out += f""",
f{k} AS (SELECT arc.session, from_idx AS idx, min(ROW(pos, -e, to_idx)) AS best FROM r{k - 1} r JOIN arc ON arc.session = r.session AND to_idx = r.idx ANTI JOIN u{k - 1} u ON u.session = arc.session AND u.idx = from_idx GROUP BY ALL),
r{k} AS (SELECT session, idx, {k} AS depth, best[3] AS via, row_number() OVER (PARTITION BY session ORDER BY best[1], best[2], idx DESC) AS pos FROM f{k}), u{k} AS (SELECT * FROM u{k - 1} UNION ALL SELECT * FROM r{k})"""
    return f"""{out},
hits AS (SELECT * FROM u{depth} WHERE depth > 0),
weights AS (SELECT arc.session, from_idx AS idx, max(e) AS w FROM arc JOIN u{depth - 1} u ON u.session = arc.session AND u.idx = to_idx GROUP BY ALL)"""


WALK = walk_sql(DEPTH)
