"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, mixing, pieces, quality, rendezvous, simhash, spotsigs, substrings, toxicity, warc
from .workspace import Workspace, documents

SHARDS = {s: 1.0 + s % 3 for s in range(16)}
MORE_SHARDS = SHARDS | {16: 2.0}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived as a WARC response record and read back."""
    return warc.pages_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document that lie in passages of 50 words which an earlier one has. The index of all batches stays in a new
    folder passages-index-* of the shared one, for later batches."""
    return substrings.repeated_passages(documents(spark, sf_dir), "doc_id", "text", path=Workspace(spark, "passages-index").path)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a similar one, its class and number of links."""
    return spotsigs.similar_documents(documents(spark, sf_dir), "doc_id", "text")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document before and after one shard is added."""
    docs = documents(spark, sf_dir).select("doc_id")
    out = rendezvous.assign(rendezvous.assign(docs, "doc_id", SHARDS), "doc_id", MORE_SHARDS, "shard_after")
    return out.withColumn("moved", F.col("shard") != F.col("shard_after"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn in proportion to the root of their source's tokens, with epoch, start and tokens used."""
    counted = documents(spark, sf_dir).select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    docs = Workspace(spark, "tokens").table(counted, "counts")
    return mixing.mix(docs, "source", "n_tokens", "doc_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document and whether they decode to its text."""
    return pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a near or equal one, its group and the one that stays."""
    return simhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score, a threshold and a decision for every document."""
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "lang")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every further copy of a text and the first one."""
    return chunks.duplicates(documents(spark, sf_dir), "doc_id", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight, a key and a decision for every document."""
    return quality.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_spotsigs, op4_sharding, op5_mixing, op6_sentencepiece, op7_simhash, op8_toxicity, op9_exact_dedup, op10_quality)}


def _sharding() -> str:
    def scored(weights: dict[int, float], name: str) -> str:
        rows = ", ".join(f"({s}, {w!r}::double, {a}::bigint, {b}::bigint, {c}::bigint)" for s, w, a, b, c in rendezvous.shard_rows(weights))
        p = rendezvous.PRIME
        return f"""{name}_y AS (SELECT doc_id, x2, s, w, a, c, (a * x1 + b) % {p} AS y FROM keys, (VALUES {rows}) AS v(s, w, a, b, c)),
{name}_z AS (SELECT doc_id, s, w, y, (y * c + x2 * a) % {p} AS z FROM {name}_y),
{name}_r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY -w / ln(((z * z + y) % {p} + 1) / {float(p + 1)!r}::double) DESC, s) AS n FROM {name}_z),
{name} AS (SELECT doc_id, s FROM {name}_r WHERE n = 1)"""

    return f"""WITH keys AS (SELECT doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 7))::bigint AS x1, ('0x' || substr(md5(doc_id::varchar), 8, 7))::bigint AS x2 FROM documents),
{scored(SHARDS, "before")},
{scored(MORE_SHARDS, "later")}
SELECT before.doc_id, before.s::int AS shard, later.s::int AS shard_after, before.s <> later.s AS moved FROM before JOIN later USING (doc_id)"""


TOKENS = r"len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))"


def mixing_sql(table: str, seed: str = "mix") -> str:
    """doc_id, source, n_tokens, epoch, start, take over a table with doc_id, source and n_tokens."""
    return f"""rows AS (SELECT doc_id, source, n_tokens, coalesce(source, '') AS s, ('0x' || substr(md5('{seed}|' || coalesce(source, '') || '|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint AS k FROM {table} WHERE n_tokens > 0),
totals AS (SELECT s, sum(n_tokens)::hugeint AS total, floor(sqrt(sum(n_tokens)::double))::hugeint AS w FROM rows GROUP BY s),
budgets AS (SELECT s, total, ((SELECT sum(total) FROM totals) * w // (SELECT sum(w) FROM totals)) AS budget FROM totals),
placed AS (SELECT rows.*, total, budget, coalesce(sum(n_tokens) OVER (PARTITION BY s ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows JOIN budgets USING (s)),
counted AS (SELECT *, budget // total AS n_full, budget % total AS rest FROM placed),
mixed AS (SELECT doc_id, source, n_tokens, unnest(range((n_full + CASE WHEN start < rest THEN 1 ELSE 0 END)::bigint)) AS epoch, start, n_full, rest FROM counted)
SELECT doc_id, source, n_tokens, epoch::bigint AS epoch, start::bigint AS start, (CASE WHEN epoch < n_full THEN n_tokens ELSE least(n_tokens, rest - start) END)::bigint AS take FROM mixed"""


ORACLES: dict[str, str] = {
    "op1_warc": f"SELECT page_id, url, html, strlen(html) + {len(warc.HTTP_HEADER)} AS content_length, 'ok' AS status FROM pages",
    "op4_sharding": _sharding(),
    "op5_mixing": f"WITH counted_tokens AS (SELECT doc_id, source, {TOKENS}::bigint AS n_tokens FROM documents),\n{mixing_sql('counted_tokens')}",
    "op9_exact_dedup": "SELECT doc_id, first_doc_id FROM (SELECT doc_id, first_value(doc_id) OVER w AS first_doc_id, row_number() OVER w AS n FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE n > 1",
}


_PASSAGES = rf"""WITH RECURSIVE cut AS (SELECT doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % {substrings.BATCHES} AS batch, regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
placed AS (SELECT doc_id, batch, w, unnest(range(1, len(w) - 48)) AS i FROM cut WHERE len(w) >= 50),
passages AS (SELECT doc_id, batch, i, md5(array_to_string(w[i:i + 49], ' ')) AS p FROM placed),
firsts AS (SELECT p, arg_min(doc_id, (batch, doc_id)) AS first_id FROM passages GROUP BY p),
late AS (SELECT doc_id, i FROM passages JOIN firsts USING (p) WHERE doc_id <> first_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS head FROM late),
runs AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT doc_id, (min(i) - 1)::int AS start_word, (max(i) - min(i) + 50)::int AS n_words FROM runs GROUP BY doc_id, run"""


def _spotsigs() -> str:
    common, anchors = (", ".join(f"'{w}'" for w in sorted(set(x))) for x in (spotsigs.COMMON, spotsigs.ANCHORS))
    return rf"""WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM cut),
ranked AS (SELECT *, word NOT IN ({common}) AS content, sum((word NOT IN ({common}))::int) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM words),
chains AS (SELECT doc_id, r, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM ranked WHERE content WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sigs AS (SELECT DISTINCT x.doc_id, x.word || ' ' || a || ' ' || b || ' ' || c AS sig FROM ranked x JOIN chains y ON x.doc_id = y.doc_id AND y.r = x.r + CASE WHEN x.content THEN 0 ELSE 1 END WHERE x.word IN ({anchors}) AND c IS NOT NULL),
sized AS (SELECT doc_id, count(*) AS n, md5(string_agg(sig, chr(10) ORDER BY sig)) AS whole FROM sigs GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sigs x JOIN sigs y ON x.sig = y.sig AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE shared.n / (x.n + y.n - shared.n)::double >= {spotsigs.THRESHOLD}),
reached AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a),
classes AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reached GROUP BY doc_id),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
alike AS (SELECT whole, count(*) AS copies FROM sized GROUP BY whole)
SELECT doc_id, class_id, class_size, copies, n_links FROM classes JOIN counted USING (doc_id) JOIN sized USING (doc_id) JOIN alike USING (whole)"""


ORACLES |= {"op2_substring_dedup": _PASSAGES, "op3_spotsigs": _spotsigs()}
