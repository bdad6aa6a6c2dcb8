"""Queries over document trees, caches, scopes and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import cache, outline, vision
from textloom.operators import edits as E
from textloom.sources import corpus, detect
from textloom.streaming import incremental

REGISTERED: dict = {}


def query(sql: str | None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A document a region: nations as sections, customers as headings, orders as paragraphs; position by key."""
    n = corpus.read(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").cast("int").alias("position"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("section").alias("kind"), F.col("n_name").alias("title"), F.lit(1).alias("page"), "n_nationkey")
    c = corpus.read(spark, sf, "customer").join(n.select("n_nationkey", "doc_id"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("doc_id", F.col("c_custkey").cast("int").alias("position"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.lit("heading").alias("kind"), F.col("c_name").alias("title"), (F.col("c_custkey") % 9 + 1).cast("int").alias("page"), "c_custkey")
    o = corpus.read(spark, sf, "orders").join(c.select("c_custkey", "doc_id"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("doc_id", F.col("o_orderkey").cast("int").alias("position"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent_id"), F.lit("paragraph").alias("kind"), F.col("o_orderstatus").alias("title"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("page"))
    return n.drop("n_nationkey").unionByName(c.drop("c_custkey")).unionByName(o)


_NODES = """nodes AS (SELECT n_regionkey::bigint AS doc_id, n_nationkey::int AS position, 'n' || n_nationkey AS id, NULL::varchar AS parent_id, 'section' AS kind, n_name AS title, 1 AS page FROM nation
UNION ALL SELECT n_regionkey, c_custkey::int, 'c' || c_custkey, 'n' || c_nationkey, 'heading', c_name, (c_custkey % 9 + 1)::int FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, o_orderkey::int, 'o' || o_orderkey, 'c' || o_custkey, 'paragraph', o_orderstatus, (o_orderkey % 9 + 1)::int FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
placed AS (SELECT *, 0 AS depth, [position::bigint] AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.*, p.depth + 1, list_append(p.path, n.position::bigint) FROM nodes n JOIN placed p ON n.doc_id = p.doc_id AND n.parent_id = p.id)"""


@query(f"WITH RECURSIVE {_NODES} SELECT doc_id, id, depth, (row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1)::int AS number FROM placed")
def tree_preorder(spark, sf):
    return outline.preorder(outline.paths(nodes(spark, sf))).select("doc_id", "id", "depth", "number")


@query(f"""WITH RECURSIVE {_NODES}, kept AS (SELECT * FROM placed WHERE page = 3 AND kind <> 'section') SELECT k.doc_id, k.id, p.id AS parent_id, k.kind, k.depth FROM kept k LEFT JOIN kept p ON k.doc_id = p.doc_id AND k.parent_id = p.id""")
def tree_page(spark, sf):
    return outline.select(outline.paths(nodes(spark, sf)), page=3).select("doc_id", "id", "parent_id", "kind", "depth")


@query(f"""WITH RECURSIVE {_NODES}, kept AS (SELECT * FROM placed WHERE kind IN ('section', 'paragraph') AND depth <= 2) SELECT k.doc_id, k.id, p.id AS parent_id, k.kind, k.depth FROM kept k LEFT JOIN kept p ON k.doc_id = p.doc_id AND k.parent_id = p.id""")
def tree_kinds(spark, sf):
    return outline.select(outline.paths(nodes(spark, sf)), kinds=["section", "paragraph"], depth=2).select("doc_id", "id", "parent_id", "kind", "depth")


@query(f"""WITH RECURSIVE {_NODES}, tops AS (SELECT doc_id, min(position) AS position FROM nodes WHERE kind = 'section' GROUP BY doc_id) SELECT p.doc_id, p.id, p.depth FROM placed p JOIN tops t ON p.doc_id = t.doc_id AND p.path[1] = t.position""")
def tree_subtree(spark, sf):
    placed = outline.paths(nodes(spark, sf))
    top = placed.where("kind = 'section'").groupBy("doc_id").agg(F.min_by("id", "position").alias("id"))
    return outline.subtree(placed, top).select("doc_id", "id", "depth")


@query(f"WITH RECURSIVE {_NODES} SELECT doc_id, 'section' AS kind FROM nodes GROUP BY doc_id")
def tree_overview(spark, sf):
    return outline.overview(nodes(spark, sf))


@query(f"WITH RECURSIVE {_NODES} SELECT doc_id, string_agg(repeat('  ', depth) || title || ' (p. ' || page || ')', chr(10) ORDER BY path) AS text FROM placed WHERE depth < 2 GROUP BY doc_id")
def tree_render(spark, sf):
    return outline.render(outline.paths(nodes(spark, sf), 2))


@query("""WITH h AS (SELECT c_nationkey::bigint AS doc_id, c_custkey::int AS position, (c_custkey * 7 % 6 + 1)::int AS level FROM customer)
SELECT doc_id, position, level, (SELECT max(b.position) FROM h b WHERE b.doc_id = a.doc_id AND b.position < a.position AND b.level < a.level) AS parent_position FROM h a""")
def heading_parents(spark, sf):
    h = corpus.read(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").cast("int").alias("position"), (F.col("c_custkey") * 7 % 6 + 1).cast("int").alias("level"))
    return outline.heading_parents(h)


@query("""SELECT conv_id AS doc_id, string_agg('<page number="' || turn || '">' || chr(10) || text || chr(10) || '</page>', chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id""")
def tagged_pages(spark, sf):
    return outline.tagged_pages(corpus.read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("""WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' ELSE 'a..b/c' END AS path, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1.0 END AS x, 1.0 AS y FROM part)
SELECT id, path FROM a WHERE starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') OR x IS NULL""")
def invalid_assets(spark, sf):
    k = F.col("p_partkey")
    assets = corpus.read(spark, sf, "part").select(k.alias("id"), F.when(k % 4 == 0, "/abs").when(k % 4 == 1, "a/../b").otherwise("a..b/c").alias("path"), F.when(k % 3 != 0, 1.0).alias("x"), *(F.lit(1.0).alias(c) for c in ("y", "width", "height")))
    return outline.invalid_assets(assets).select("id", "path")


def _states(spark, sf):
    docs = corpus.read(spark, sf, "documents")
    path, digest = F.col("doc_id").cast("string"), F.sha2("text", 256)
    old = docs.where("n_chars % 5 <> 0").select(path.alias("path"), digest.alias("file_hash"))
    new = docs.where("n_chars % 7 <> 0").select(path.alias("path"), F.when(F.col("n_chars") % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(digest).alias("file_hash"))
    return old, new


_STATES = "WITH o AS (SELECT doc_id::varchar AS path, sha256(text) AS a FROM documents WHERE n_chars % 5 <> 0), n AS (SELECT doc_id::varchar AS path, sha256(CASE WHEN n_chars % 3 = 0 THEN text || 'x' ELSE text END) AS b FROM documents WHERE n_chars % 7 <> 0)"


@query(_STATES + " SELECT count(*) FILTER (a IS NULL) AS created, count(*) FILTER (b IS NULL) AS removed, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a = b) AS unchanged FROM o FULL JOIN n USING (path)")
def update_stats(spark, sf):
    return cache.update_stats(*_states(spark, sf))


@query(_STATES + " SELECT path, a AS file_hash FROM o WHERE a NOT IN (SELECT b FROM n)")
def stale_cache(spark, sf):
    return cache.stale(*_states(spark, sf)).select("path", "file_hash")


@query(_STATES + " SELECT DISTINCT b AS file_hash FROM n WHERE b NOT IN (SELECT a FROM o)")
def missing_cache(spark, sf):
    old, new = _states(spark, sf)
    return cache.missing(new, old).select("file_hash")


_TASKS = """WITH c AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'c' || vec_id WHEN vec_id % 3 = 0 THEN '' END AS caption, CASE WHEN vec_id % 5 = 0 THEN 'o' END AS ocr FROM embeddings WHERE vec_id % 11 <> 0),
f AS (SELECT vec_id, 'new' AS caption, 'new' AS ocr FROM embeddings WHERE label % 2 = 0)"""


def _vision(spark, sf):
    e = corpus.read(spark, sf, "embeddings")
    v = F.col("vec_id")
    old = e.where(v % 11 != 0).select("vec_id", F.when(v % 2 == 0, F.concat(F.lit("c"), v.cast("string"))).when(v % 3 == 0, "").alias("caption"), F.when(v % 5 == 0, "o").alias("ocr"))
    return old, e.where("label % 2 = 0").select("vec_id", F.lit("new").alias("caption"), F.lit("new").alias("ocr"))


@query(_TASKS + " SELECT vec_id, coalesce(c.caption, f.caption) AS caption, coalesce(c.ocr, f.ocr) AS ocr FROM c FULL JOIN f USING (vec_id)")
def fill_vision_cache(spark, sf):
    old, new = _vision(spark, sf)
    return cache.fill(old, new, ["vec_id"], ["caption", "ocr"])


@query(_TASKS + ", t AS (SELECT vec_id, unnest(['caption', 'ocr']) AS task FROM embeddings) SELECT vec_id, task FROM t LEFT JOIN c USING (vec_id) WHERE CASE task WHEN 'caption' THEN caption ELSE ocr END IS NULL")
def vision_tasks_to_run(spark, sf):
    old, _ = _vision(spark, sf)
    return cache.tasks_to_run(corpus.read(spark, sf, "embeddings").select("vec_id"), old, ["vec_id"], ["caption", "ocr"])


def _tree(spark, sf):
    k = F.col("doc_id")
    return corpus.read(spark, sf, "documents").select(k.alias("path"), (k % 3 == 0).alias("tracked"), (k % 3 != 0).alias("untracked"), (k % 5 == 0).alias("ignored"))


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 <> 0 AND doc_id % 5 <> 0)")
def scope_default(spark, sf):
    return detect.scoped(_tree(spark, sf)).select("path")


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0")
def scope_ignored(spark, sf):
    return detect.scoped(_tree(spark, sf), others=True, ignored=True).select("path")


def _sessions(spark, sf):
    e = corpus.read(spark, sf, "events")
    return e.select((F.col("user_id") % 50).alias("session"), (F.col("event_id") % 40).cast("string").alias("path"), F.col("event_id").alias("seq"), F.when(F.length("event_type") % 2 == 0, "anchor").otherwise("edit").alias("action"))


_SESSIONS = "WITH e AS (SELECT user_id % 50 AS session, (event_id % 40)::varchar AS path, event_id AS seq, CASE WHEN length(event_type) % 2 = 0 THEN 'anchor' ELSE 'edit' END AS action FROM events), s AS (SELECT session, path, arg_max(action, seq) = 'anchor' AS fresh FROM e GROUP BY ALL)"


@query(_SESSIONS + " SELECT session, path, fresh FROM s")
def session_state(spark, sf):
    return incremental.session_state(_sessions(spark, sf))


@query(_SESSIONS + " SELECT session, path, seq FROM e SEMI JOIN (SELECT * FROM s WHERE fresh) f USING (session, path)")
def fresh_edits(spark, sf):
    events = _sessions(spark, sf)
    return E.fresh_only(events, incremental.session_state(events).where("fresh")).select("session", "path", "seq")


_TILES = """WITH t AS (SELECT vec_id // 16 AS image, (vec_id % 16 // 4)::int AS y, (vec_id % 4)::int AS x, embedding FROM embeddings), u AS (SELECT image, y // 2 AS tile_y, x // 2 AS tile_x, y % 2 * 2 + x % 2 AS cell, embedding FROM t),
p AS (SELECT a.image, a.tile_y, a.tile_x, a.cell AS first, b.cell AS second, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS score FROM u a JOIN u b ON a.image = b.image AND a.tile_y = b.tile_y AND a.tile_x = b.tile_x AND a.cell < b.cell),
best AS (SELECT image, tile_y, tile_x, first, second FROM (SELECT *, row_number() OVER (PARTITION BY image, tile_y, tile_x ORDER BY score DESC, first, second) AS n FROM p) WHERE n = 1)"""


def _tokens(spark, sf):
    v = F.col("vec_id")
    return corpus.read(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("image"), F.expr("cast(vec_id % 16 div 4 as int)").alias("y"), (v % 4).cast("int").alias("x"), "embedding")


@query(_TILES + " SELECT image, tile_y, tile_x, first, second FROM best")
def closest_token_pairs(spark, sf):
    return vision.closest_pairs(_tokens(spark, sf)).drop("score")


@query(_TILES + ", g AS (SELECT u.*, best.first, best.second FROM u LEFT JOIN best USING (image, tile_y, tile_x)) SELECT image, (tile_y * 2 + cell // 2)::int AS y, (tile_x * 2 + cell % 2)::int AS x, CASE WHEN cell = first THEN 2 ELSE 1 END AS mass FROM g WHERE second IS NULL OR cell <> second")
def merged_tokens(spark, sf):
    return vision.merge_closest(_tokens(spark, sf)).drop("embedding")
