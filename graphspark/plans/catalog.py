"""Queries over the tables' graph and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import lexical as L
from ..operators import traverse as V
from ..schema import IMPACT_KINDS, SYMBOL_KINDS
from ..sources import tables as S
from . import sql
from .work import stepper

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- assembly ------------------------------------------------------------------------------


@query("nodes_by_kind", f"WITH {sql.FULL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def nodes_by_kind(spark, d):
    return G.metrics(S.full_graph(spark, d))["nodes_by_kind"]


@query("edges_by_kind", f"WITH {sql.FULL} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(spark, d):
    return G.metrics(S.full_graph(spark, d))["edges_by_kind"]


@query("language_histogram", "SELECT lang AS language, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang")
def language_histogram(spark, d):
    files = S.load(spark, d, "documents").select(F.lit("file").alias("kind"), F.create_map(F.lit("language"), "lang").alias("meta"))
    return G.metrics(G.Graph(files, S.relational_graph(spark, d).edges))["languages"]


@query("edge_ids", f"WITH {sql.RELATIONAL} SELECT id, kind, src, dst FROM edges")
def edge_ids(spark, d):
    return S.relational_graph(spark, d).edges


@query("content_ids", "SELECT doc_id, 'doc://' || array_to_string(list_filter([trim(source), trim(lang), CAST(doc_id AS VARCHAR)], lambda p: p <> ''), '#') AS id FROM documents")
def content_ids(spark, d):
    from ..functions.ids import content_id

    return S.load(spark, d, "documents").select("doc_id", content_id("doc", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query(
    "merge_nodes_first_wins",
    """SELECT 'user://' || user_id AS id, arg_min(event_type, event_id) FILTER (WHERE event_type <> '') AS name,
    arg_min(CASE WHEN value > 50 THEN event_type ELSE '' END, event_id) FILTER (WHERE CASE WHEN value > 50 THEN event_type ELSE '' END <> '') AS package FROM events GROUP BY user_id""",
)
def merge_nodes_first_wins(spark, d):
    rows = S.load(spark, d, "events").select(F.concat(F.lit("user://"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("name"), F.when(F.col("value") > 50, F.col("event_type")).otherwise("").alias("package"), "event_id")
    return G.merge_nodes(rows, "event_id")


@query(
    "merge_meta_last_wins",
    """WITH v AS (SELECT user_id, event_id, event_type AS key, CASE WHEN value > 20 THEN CAST(event_id AS VARCHAR) ELSE '' END AS value FROM events),
    f AS (SELECT user_id, min(event_id) AS first FROM v GROUP BY user_id)
    SELECT 'user://' || v.user_id AS id, key, coalesce(arg_max(value, event_id) FILTER (WHERE value <> ''), '') AS value FROM v JOIN f USING (user_id) WHERE value <> '' OR event_id = first GROUP BY v.user_id, key""",
)
def merge_meta_last_wins(spark, d):
    value = F.when(F.col("value") > 20, F.col("event_id").cast("string")).otherwise("")
    rows = S.load(spark, d, "events").select(F.concat(F.lit("user://"), F.col("user_id").cast("string")).alias("id"), F.create_map("event_type", value).alias("meta"), "event_id")
    return G.merge_meta(rows, "event_id").select("id", F.explode("meta").alias("key", "value"))


@query(
    "merge_edges",
    f"WITH {sql.RELATIONAL}, e AS (SELECT id, kind, src, dst FROM edges UNION ALL SELECT id, kind, src, dst FROM edges WHERE kind = 'contains') SELECT id, min(kind) AS kind, min(src) AS src, min(dst) AS dst FROM e GROUP BY id",
)
def merge_edges(spark, d):
    e = S.relational_graph(spark, d).edges
    again = e.filter("kind = 'contains'").withColumn("id", F.lit("")).withColumn("o", F.lit(2))
    return G.merge_edges(e.withColumn("o", F.lit(1)).unionByName(again), "o")


@query(
    "folder_topology",
    """WITH p AS (SELECT DISTINCT string_split(source || '/' || lang || '/' || doc_id, '/') AS s FROM documents), x AS (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p)
    SELECT DISTINCT CASE WHEN i = 1 THEN '.' ELSE array_to_string(s[1:i-1], '/') END AS parent, array_to_string(s[1:i], '/') AS child FROM x""",
)
def folder_topology(spark, d):
    return G.folders(S.text_graph(spark, d).nodes.filter("id LIKE 'document://%'"))


@query("valid_edges", f"WITH {sql.RELATIONAL}, n AS (SELECT id FROM nodes WHERE kind <> 'type') SELECT id, kind, src, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def valid_edges(spark, d):
    g = S.relational_graph(spark, d)
    return G.valid_edges(G.Graph(g.nodes.filter("kind <> 'type'"), g.edges))


@query("symbols", f"WITH {sql.RELATIONAL} SELECT id, kind, name FROM nodes WHERE kind IN {sql.listed(SYMBOL_KINDS)}")
def symbols(spark, d):
    return G.symbols(S.relational_graph(spark, d)).select("id", "kind", "name")


@query(
    "workspace_merge",
    f"""WITH {sql.RELATIONAL}, x AS (SELECT a || '::' || src AS src, a || '::' || dst AS dst, kind FROM edges, (VALUES ('left'), ('right')) t(a) WHERE kind = 'contains' OR a = 'left')
    SELECT {sql.EDGE_ID} AS id, kind, src, dst FROM x""",
)
def workspace_merge(spark, d):
    g = S.relational_graph(spark, d)
    return G.merge_workspaces({"left": g, "right": G.Graph(g.nodes, g.edges.filter("kind = 'contains'"))}).edges.select("id", "kind", "src", "dst")


# --- analytics -----------------------------------------------------------------------------

DEGREES = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"


@query("central_nodes", f"WITH {sql.RELATIONAL}, {DEGREES} SELECT n.id, kind, name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) ORDER BY degree DESC, n.id LIMIT 20")
def central_nodes(spark, d):
    return A.central_nodes(S.relational_graph(spark, d))


def _fan(incoming: bool) -> None:
    end = "dst" if incoming else "src"
    oracle = f"WITH {sql.RELATIONAL}, f AS (SELECT {end} AS id, count(*) AS degree FROM edges GROUP BY 1) SELECT n.id, kind, degree FROM nodes n JOIN f USING (id) WHERE kind IN {sql.listed((*SYMBOL_KINDS, 'import'))} ORDER BY degree DESC, id LIMIT 20"
    query("high_fan_in" if incoming else "high_fan_out", oracle)(lambda spark, d: A.high_fan(S.relational_graph(spark, d), incoming))


_fan(True)
_fan(False)


@query(
    "core_packages",
    f"WITH {sql.RELATIONAL}, {DEGREES} SELECT n.id, path, coalesce(degree, 0) AS degree, CAST(row_number() OVER (ORDER BY coalesce(degree, 0) DESC, path, n.id) AS INTEGER) AS place FROM nodes n LEFT JOIN d USING (id) WHERE kind = 'package'",
)
def core_packages(spark, d):
    return A.core_packages(S.relational_graph(spark, d))


@query("top_imports", f"WITH {sql.RELATIONAL}, c AS (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'depends_on' GROUP BY 1) SELECT id, name, n FROM nodes JOIN c USING (id) WHERE kind = 'module' ORDER BY n DESC, name, id LIMIT 20")
def top_imports(spark, d):
    return A.top_imports(S.relational_graph(spark, d), "depends_on", "module")


@query("entry_points", f"WITH {sql.RELATIONAL} SELECT id FROM nodes WHERE (kind = 'function' AND name = 'Order 7')")
def entry_points(spark, d):
    g = S.relational_graph(spark, d)
    renamed = g.nodes.withColumn("name", F.when(F.col("name") == "Order 7", "main").otherwise(F.col("name")))
    return A.entry_points(G.Graph(renamed, g.edges)).select("id")


@query(
    "reading_order",
    f"WITH {sql.RELATIONAL}, {DEGREES} SELECT n.id, 1 AS part, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, path, n.id) AS rank FROM nodes n LEFT JOIN d USING (id) WHERE kind = 'package' ORDER BY rank LIMIT 12",
)
def reading_order(spark, d):
    return A.reading_order(S.relational_graph(spark, d))


@query(
    "hub_threshold_p99",
    f"""WITH {sql.RELATIONAL}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst), d AS (SELECT id, count(*) AS k FROM e GROUP BY id)
    SELECT greatest(50, CAST(quantile_disc(coalesce(k, 0), 0.99) AS BIGINT)) AS threshold FROM nodes LEFT JOIN d USING (id)""",
)
def hub_threshold(spark, d):
    return A.hub_threshold(S.relational_graph(spark, d))


@query(
    "community_hub_threshold",
    f"WITH {sql.RELATIONAL}, e AS (SELECT src AS id FROM edges WHERE src <> dst UNION ALL SELECT dst FROM edges WHERE src <> dst), d AS (SELECT id, count(*) AS k FROM e GROUP BY id) SELECT greatest(5, CAST(quantile_disc(k, 0.99) AS BIGINT)) AS threshold FROM d",
)
def community_hub_threshold(spark, d):
    return A.community_hub_threshold(S.relational_graph(spark, d), 5)


def _view(view: str, kinds: str, central: int = 0, edges: bool = True) -> None:
    """Nodes and edges of a view, with the kinds written out."""
    chosen = f"SELECT id FROM nodes WHERE kind IN ({kinds})"
    top = f", {DEGREES}, t AS (SELECT n.id FROM nodes n LEFT JOIN d USING (id) ORDER BY coalesce(degree, 0) DESC, n.id LIMIT {central})" if central else ""
    among = "UNION ALL SELECT 'edge', e.kind, e.id FROM edges e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)" if edges else ""
    oracle = f"WITH {sql.FULL}{top}, v AS ({chosen}{' UNION SELECT id FROM t' if central else ''}) SELECT 'node' AS part, kind, id FROM nodes WHERE id IN (SELECT id FROM v) {among}"

    def run(spark, d):
        found = A.workflow_view(S.full_graph(spark, d), view)
        return found.nodes.select(F.lit("node").alias("part"), "kind", "id").unionByName(found.edges.select(F.lit("edge").alias("part"), "kind", "id"))

    query(f"workflow_{view}", oracle)(run)


_view("tech", "'package', 'module', 'schema', 'table', 'view'", edges=False)
_view("understand", "'domain', 'flow', 'step', 'concept'", 20)
_view("learn", "'tour'", 30)
_view("docs", "'document', 'section', 'concept'")
_view("pdf", "'document', 'section', 'concept'")


@query(
    "workflow_diff",
    f"""WITH {sql.RELATIONAL}, p AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT id FROM nodes WHERE id = 'supplier://3' OR path = 'world/NATION_2' OR lower(name) = lower('ORDER 5')),
    l1 AS (SELECT id FROM s UNION SELECT b FROM p WHERE a IN (SELECT id FROM s)), l2 AS (SELECT id FROM l1 UNION SELECT b FROM p WHERE a IN (SELECT id FROM l1)) SELECT id FROM l2 WHERE id IN (SELECT id FROM nodes)""",
)
def workflow_diff(spark, d):
    targets = spark.createDataFrame([("supplier://3",), ("world/NATION_2",), ("ORDER 5",)], "target string")
    return V.impact(S.relational_graph(spark, d), targets, step=stepper(spark)).select("id")


@query(
    "changed_removed",
    """WITH b AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT 'doc/' || doc_id AS path, sha256(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 11 <> 0)
    SELECT path, CASE WHEN a.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE a.hash IS NULL OR b.hash IS NULL OR a.hash <> b.hash""",
)
def changed_removed(spark, d):
    docs = S.load(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    before = docs.filter("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    after = docs.filter("doc_id % 11 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")), 256).alias("hash"))
    return A.changes(before, after)


@query(
    "snapshot_equal",
    """WITH s AS (SELECT source, doc_id, sha256(text) AS hash, CASE WHEN doc_id % 997 = 1 THEN sha256(text || '!') ELSE sha256(text) END AS later FROM documents)
    SELECT source, bool_and(hash = later) AS same FROM s GROUP BY source""",
)
def snapshot_equal(spark, d):
    """Each source's scan against a later one, in which a document of each 997 has another text."""
    docs = S.load(spark, d, "documents")
    path, later = F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 997 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return A.same_scans(docs.select("source", path, F.sha2("text", 256).alias("hash")), docs.select("source", path, F.sha2(later, 256).alias("hash")).orderBy("hash"), "source")


@query(
    "enrichment_freshness",
    """WITH r AS (SELECT source AS id, doc_id, sha256(text || CASE WHEN doc_id % 997 = 1 THEN '!' ELSE '' END) AS old, sha256(text) AS cur FROM documents)
    SELECT id FROM r GROUP BY id HAVING bool_and(old = cur)""",
)
def enrichment_freshness(spark, d):
    docs = S.load(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    old = F.sha2(F.concat("text", F.when(F.col("doc_id") % 997 == 1, "!").otherwise("")), 256)
    rows = docs.groupBy(F.col("source").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("path", old))).alias("hashes"))
    return A.fresh_enrichment(rows, docs.select("path", F.sha2("text", 256).alias("hash")))


@query(
    "task_batches",
    "SELECT lang AS g0, CAST((rn - 1) // 25 AS INTEGER) AS batch, count(*) AS n, min(path) AS first, max(path) AS last FROM (SELECT lang, CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) AS rn FROM documents) GROUP BY 1, 2",
)
def task_batches(spark, d):
    docs = S.load(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("path"))
    made = A.batches(docs, [F.col("lang")], 25)
    return made.select("g0", "batch", F.size("paths").cast("bigint").alias("n"), F.col("paths")[0].alias("first"), F.element_at("paths", -1).alias("last"))


TURNS = "t AS (SELECT DISTINCT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations), p AS (SELECT src, dst FROM t WHERE dst IS NOT NULL)"


@query(
    "import_cycles_scc",
    f"WITH RECURSIVE {TURNS}, r(a, b) AS (SELECT src, dst FROM p UNION SELECT r.a, p.dst FROM r JOIN p ON r.b = p.src) SELECT x.a AS id, min(least(x.a, x.b)) AS component FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.a = x.b AND y.b = x.a) GROUP BY x.a",
)
def import_cycles_scc(spark, d):
    turns = S.load(spark, d, "conversations")
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select(F.col("role").alias("src"), after.alias("dst")).filter("dst IS NOT NULL").distinct()
    return A.strong_components(spark, pairs, stepper(spark))


def _flows_sql() -> str:
    """Chains unrolled: six places, the next one the callee not in the chain that calls most."""
    e = "SELECT DISTINCT src, dst FROM edges WHERE kind IN ('depends_on', 'defines')"
    known = "SELECT id FROM nodes WHERE kind IN ('type', 'struct', 'interface', 'function', 'method', 'variable', 'module', 'class')"
    parts = [
        f"c AS MATERIALIZED (SELECT * FROM ({e}) WHERE src IN ({known}) AND dst IN ({known}))",
        "o AS MATERIALIZED (SELECT src AS id, count(*) AS n, bool_or(src <> dst) AS others FROM c GROUP BY src)",
        "w AS MATERIALIZED (SELECT c.src, c.dst, coalesce(o.n, 0) AS n FROM c LEFT JOIN o ON o.id = c.dst)",
        "f0 AS (SELECT o.id AS seed, [o.id] AS chain FROM o JOIN nodes USING (id) WHERE others ORDER BY CASE WHEN name = 'main' THEN 0 WHEN o.id NOT IN (SELECT dst FROM c) THEN 1 ELSE 2 END, o.n DESC, o.id LIMIT 10)",
    ]
    for k in range(1, 6):
        best = f"SELECT seed, arg_min(dst, (-n, dst)) AS dst FROM f{k - 1} JOIN w ON src = chain[-1] WHERE NOT list_contains(chain, dst) GROUP BY seed"
        parts.append(f"f{k} AS (SELECT f.seed, CASE WHEN b.dst IS NULL THEN chain ELSE list_append(chain, b.dst) END AS chain FROM f{k - 1} f LEFT JOIN ({best}) b USING (seed))")
    return f"WITH {sql.RELATIONAL}, {', '.join(parts)} SELECT seed, array_to_string(chain, ' -> ') AS flow FROM f5"


@query("call_flows", _flows_sql())
def call_flows(spark, d):
    """Definitions and dependencies as calls; every node has a path, its id."""
    g = S.relational_graph(spark, d)
    calls = g.edges.withColumn("kind", F.when(F.col("kind").isin("depends_on", "defines"), "calls").otherwise("other"))
    return A.call_flows(G.Graph(g.nodes.withColumn("path", F.col("id")), calls))


# --- traversal -----------------------------------------------------------------------------


@query("explain_node", f"WITH {sql.RELATIONAL}, x AS (SELECT DISTINCT 'out' AS direction, kind, dst AS id FROM edges WHERE src = 'part://10' UNION SELECT 'in', kind, src FROM edges WHERE dst = 'part://10') SELECT direction, x.kind, x.id, name FROM x JOIN nodes USING (id)")
def explain_node(spark, d):
    return V.neighbours(S.relational_graph(spark, d), "part://10")


@query("induced_subgraph", f"WITH {sql.RELATIONAL}, n AS (SELECT id FROM nodes WHERE package = 'nation://3' OR id LIKE 'nation://%') SELECT id, kind, src, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def induced_subgraph(spark, d):
    g = S.relational_graph(spark, d)
    return G.induced(g, g.nodes.filter("package = 'nation://3' OR id LIKE 'nation://%'")).edges


def _levels(seeds: str, pairs: str, depth: int) -> str:
    parts = [f"l0 AS (SELECT id, 0 AS distance FROM ({seeds}))"]
    for k in range(1, depth + 1):
        parts.append(f"l{k} AS (SELECT id, distance FROM l{k - 1} UNION ALL SELECT DISTINCT b AS id, {k} AS distance FROM p WHERE a IN (SELECT id FROM l{k - 1} WHERE distance = {k - 1}) AND b NOT IN (SELECT id FROM l{k - 1}))")
    return f"WITH {sql.RELATIONAL}, p AS ({pairs}), {', '.join(parts)} SELECT id, distance FROM l{depth}"


@query("bfs_distance_k3", _levels("SELECT 'customer://1' AS id", "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges", 3))
def bfs_distance(spark, d):
    return V.distances(V.pairs_of(S.relational_graph(spark, d), distinct=False), spark.createDataFrame([("customer://1",)], "id string"), 3, stepper(spark))


@query("reverse_impact_k2", _levels("SELECT 'supplier://1' AS id", f"SELECT DISTINCT dst AS a, src AS b FROM edges WHERE kind IN {sql.listed(IMPACT_KINDS)}", 2))
def reverse_impact(spark, d):
    return V.reverse_impact(S.relational_graph(spark, d), spark.createDataFrame([("supplier://1",)], "id string"), 2, IMPACT_KINDS, stepper(spark))


@query("impact_undirected_k2", _levels("SELECT 'nation://1' AS id", "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges", 2))
def impact_undirected(spark, d):
    return V.distances(V.pairs_of(S.relational_graph(spark, d), distinct=False), spark.createDataFrame([("nation://1",)], "id string"), 2, stepper(spark))


def _path(spark, d, source, target):
    mode, ids = V.shortest_path(S.relational_graph(spark, d), source, target, step=stepper(spark))
    return spark.createDataFrame([(mode, len(ids) - 1)], "mode string, hops int")


def _hops(direction: str, source: str, target: str, mode: str) -> str:
    pairs = "SELECT DISTINCT src AS a, dst AS b FROM edges" + (" UNION SELECT dst, src FROM edges" if direction == "both" else "")
    inner = _levels(f"SELECT '{source}' AS id", pairs, 5)
    return f"SELECT '{mode}' AS mode, distance AS hops FROM ({inner}) WHERE id = '{target}'"


query("shortest_path_directed", _hops("out", "region://0", "supplier://2", "directed"))(lambda spark, d: _path(spark, d, "region://0", "supplier://2"))
query("shortest_path_undirected_fallback", _hops("both", "supplier://2", "region://1", "undirected_fallback"))(lambda spark, d: _path(spark, d, "supplier://2", "region://1"))


# --- text and ranking ----------------------------------------------------------------------

PART_WORDS = sql.tokens("p_name || ' ' || p_brand || ' ' || p_type")


@query("tokenize_documents", f"SELECT doc_id, len(t) AS n, array_to_string(t[1:20], ' ') AS head, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)")
def tokenize_documents(spark, d):
    words = S.load(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.slice("t", 1, 20), " ").alias("head"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "query_terms",
    f"WITH t AS (SELECT item_id, list_filter({sql.tokens('text')}, lambda w: length(w) >= 2) AS t FROM benchmark), u AS (SELECT item_id, list_filter(list_distinct(t), lambda w: NOT list_contains({sql.strings(T.STOP_WORDS)}, w)) AS k, list_distinct(t) AS a FROM t) SELECT item_id, array_to_string(list_sort(CASE WHEN len(k) = 0 THEN a ELSE k END), ' ') AS terms FROM u",
)
def query_terms(spark, d):
    return S.load(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(T.query_terms(F.col("text"))), " ").alias("terms"))


@query("trigram_postings", f"WITH t AS (SELECT p_partkey, array_to_string({sql.tokens('p_name')}, ' ') AS s FROM part), g AS (SELECT DISTINCT p_partkey, substr(s, i, 3) AS gram FROM (SELECT p_partkey, s, unnest(range(1, greatest(2, length(s) - 1))) AS i FROM t)) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def trigram_postings(spark, d):
    grams = S.load(spark, d, "part").select("p_partkey", F.explode(T.trigrams(T.normalized(F.col("p_name")))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


INDEXED = ", ".join(f"{sql.tokens(f'coalesce({f}, {chr(39)}{chr(39)})')} AS {f}_words" for f in ("name", "path", "package", "id"))
INDEX = f"ix AS MATERIALIZED (SELECT id, kind, name, {INDEXED}, []::VARCHAR[] AS meta_words FROM nodes)"
INDEX_FULL = INDEX.replace("FROM nodes)", "FROM nodes WHERE kind IN ('type', 'package', 'module', 'domain'))")
FIELD_WORDS = " UNION ALL ".join(f"SELECT id, unnest({f}_words) AS term FROM ix" for f in ("name", "path", "package", "id"))


@query("term_df_idf", f"WITH {sql.RELATIONAL}, {INDEX}, w AS ({FIELD_WORDS}) SELECT term, count(DISTINCT id) AS df, CAST(round(1000000 * ln(1 + (SELECT count(*) FROM ix) / (1 + count(DISTINCT id)))) AS BIGINT) AS idf_millionths FROM w GROUP BY term")
def term_df_idf(spark, d):
    nodes = S.relational_graph(spark, d).nodes
    df = L.document_frequencies(nodes)
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.round(1_000_000 * F.log(1 + F.col("total") / (1 + F.col("df")))).cast("bigint").alias("idf_millionths"))


@query("avg_field_length", f"WITH {sql.RELATIONAL}, {INDEX} SELECT " + ", ".join(f"CAST(sum(greatest(1, len({f}_words))) AS BIGINT) AS {f}" for f in ("name", "path", "package", "id")) + " FROM ix")
def avg_field_length(spark, d):
    index = L.build_index(S.relational_graph(spark, d).nodes)
    return index.agg(*[F.sum(f"{f}_length").alias(f) for f in ("name", "path", "package", "id")])


def search_sql(question: str, limit: int) -> str:
    """The whole score for one question, with the terms worked out here."""
    words = question.lower().split()
    terms = [w for w in dict.fromkeys(words) if w not in T.STOP_WORDS and len(w) > 1]
    df = ", ".join(f"(SELECT coalesce(nullif(count(*) FILTER (WHERE {' OR '.join(f'list_contains({f}_words, {chr(39)}{t}{chr(39)})' for f in L.FIELDS)}), 0), count(*) FILTER (WHERE contains(array_to_string(name_words, ' '), '{t}')), 0) FROM ix) AS d{i}" for i, t in enumerate(terms))
    w = ", ".join(f"ln(1 + n / (1 + d{i})) AS w{i}" for i in range(len(terms)))
    avg = ", ".join(f"greatest(1.0, avg(greatest(1, len({f}_words)))) AS a_{f}" for f in L.FIELDS)
    phrase = " ".join(terms)
    plain, tier, cover = [f"CASE WHEN nt = '{phrase}' OR it = '{phrase}' THEN {L.EXACT_PHRASE} * top WHEN starts_with(nt, '{phrase}') OR starts_with(it, '{phrase}') THEN {L.PREFIX_PHRASE} * top ELSE 0 END"], [], []
    scale = L.LONG_QUERY_SHARE if len(terms) > L.LONG_QUERY else 1.0
    for i, t in enumerate(terms):
        tf = " + ".join(f"len(list_filter({f}_words, lambda x: x = '{t}')) / (1 - {L.B} + {L.B} * greatest(1, len({f}_words)) / a_{f}) * {k}" for f, k in L.FIELDS.items())
        near = f"(contains(pt, '{t}') OR contains(kt, '{t}') OR contains(it, '{t}'))"
        before = [words[j - 1] for j, x in enumerate(words) if x == t and j]
        qualified = f"(kind IN {sql.listed(SYMBOL_KINDS)} AND list_has_any(package_words, {sql.strings(before)}))" if before else "false"
        tier.append(f"CASE WHEN nt = '{t}' THEN {L.EXACT_NAME * scale} * w{i} WHEN starts_with(nt, '{t}') THEN {L.PREFIX_NAME} * w{i} ELSE 0 END")
        plain.append(f"CASE WHEN nt = '{t}' AND {qualified} THEN {L.QUALIFIED_NAME} * w{i} ELSE 0 END")
        plain.append(f"CASE WHEN contains(nt, '{t}') AND NOT starts_with(nt, '{t}') THEN {L.INSIDE_NAME} * w{i} ELSE 0 END")
        plain.append(f"CASE WHEN ({tf}) > 0 THEN w{i} * (({tf}) * {L.K1 + 1}) / (({tf}) + {L.K1}) WHEN {near} THEN {L.INSIDE_SOURCE} * w{i} ELSE 0 END")
        cover.append(f"CAST(contains(nt, '{t}') OR ({tf}) > 0 OR {near} AS INTEGER)")
    whole = " + ".join(f"CASE WHEN list_contains(name_words, '{t}') THEN w{i} ELSE 0 END" for i, t in enumerate(terms))
    plain.append(f"CASE WHEN len(list_distinct(name_words)) > 1 AND len(list_distinct(name_words)) <= {len(terms)} AND list_has_all({sql.strings(terms)}, name_words) THEN {L.COMPOUND_NAME} * ({whole}) ELSE 0 END")
    last = " * (0.5 + c * c)" if len(terms) > 1 else ""
    return f"""WITH {sql.RELATIONAL}, {INDEX}, st AS (SELECT count(*) AS n, {avg} FROM ix), df AS (SELECT {df}), ws AS (SELECT st.*, {w} FROM st, df),
    b AS (SELECT *, array_to_string(name_words, ' ') AS nt, array_to_string(path_words, ' ') AS pt, array_to_string(package_words, ' ') AS kt, array_to_string(id_words, ' ') AS it, greatest(1.0, {', '.join(f'w{i}' for i in range(len(terms)))}) AS top FROM ix, ws),
    s AS (SELECT id, kind, name, {' + '.join(plain)} AS p, {' + '.join(tier)} AS t, ({' + '.join(cover)}) / {len(terms)} AS c FROM b),
    r AS (SELECT id, kind, name, (p + t * c * c){last} AS score FROM s)
    SELECT id, kind, name, greatest(1, CAST(round(score * 1000) AS BIGINT)) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, length(name), id LIMIT {limit}"""


query("bm25f_search", search_sql("which small widget is in nation", 25))(lambda spark, d: L.search(spark, S.relational_graph(spark, d).nodes, "which small widget is in nation", 25, stepper(spark)))
query("search_with_bonuses", search_sql("brand small ring", 25))(lambda spark, d: L.search(spark, S.relational_graph(spark, d).nodes, "brand small ring", 25, stepper(spark)))


@query(
    "trigram_candidates",
    f"WITH t AS (SELECT p_partkey, array_to_string({sql.tokens('p_name')}, ' ') AS s FROM part) SELECT 'part://' || p_partkey AS id, q AS term FROM t, (VALUES ('ring'), ('widget')) v(q) WHERE list_has_all(list_transform(range(1, greatest(2, length(s) - 1)), lambda i: substr(s, i, 3)), list_transform(range(1, length(q) - 1), lambda i: substr(q, i, 3)))",
)
def trigram_candidates(spark, d):
    return L.trigram_candidates(S.relational_graph(spark, d).nodes.filter("kind = 'type'"), ["ring", "widget"])


@query("token_estimates", "SELECT doc_id, CAST((octet_length(encode(text)) + 2) // 3 AS INTEGER) AS tokens FROM documents")
def token_estimates(spark, d):
    return S.load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "identity_dedup",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1",
)
def identity_dedup(spark, d):
    docs = S.load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("same"), "n_chars")
    return G.first_per_key(docs, ["same"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id")


@query("diversify", "SELECT p_partkey AS id, CAST(n <= 2 AS BOOLEAN) AS early FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS n FROM part)")
def diversify(spark, d):
    n = F.row_number().over(Window.partitionBy("p_type", "p_name").orderBy("p_partkey"))
    return S.load(spark, d, "part").select(F.col("p_partkey").alias("id"), (n <= 2).alias("early"))



