"""Queries over labels, communities' meta data, shortlists, cycles, identifiers and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import describe as D
from ..operators import evaluate as E
from ..operators import shortlist as H
from ..operators import traverse as V
from ..schema import SYMBOL_KINDS
from ..sources import tables as S
from . import sql
from .catalog import query
from .work import stepper

SYMBOLS = sql.listed(("type", "struct", "interface", "function", "method", "variable", "module", "class"))


@query(
    "node_labels",
    f"""WITH {sql.FULL} SELECT id, CASE WHEN coalesce(package, '') <> '' AND kind IN ('function', 'method', 'type', 'struct', 'interface') THEN package || '.' || name ELSE name END AS display,
    CASE WHEN coalesce(path, '') <> '' AND kind IN ('file', 'package') THEN path WHEN coalesce(path, '') <> '' AND kind IN {SYMBOLS} THEN path || ':' || name WHEN coalesce(package, '') <> '' AND kind IN ('function', 'method', 'type', 'struct', 'interface') THEN package || '.' || name ELSE name END AS report,
    CASE WHEN coalesce(path, '') <> '' THEN path ELSE name END AS result FROM nodes""",
)
def node_labels(spark, d):
    nodes = S.full_graph(spark, d).nodes
    kind, name, path, package = (F.col(c) for c in ("kind", "name", "path", "package"))
    return nodes.select("id", T.display_name(kind, name, path, package).alias("display"), T.report_label(kind, name, path, package, SYMBOL_KINDS).alias("report"), T.result_label(kind, name, path, F.lit(0), SYMBOL_KINDS).alias("result"))


@query("bounded_texts", "SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 300 THEN octet_length(encode(coalesce(text, ''))) END AS whole, octet_length(encode(coalesce(text, ''))) > 300 AS cut FROM documents")
def bounded_texts(spark, d):
    """Texts in a hundred tokens: those that fit are whole; the others end in a mark and are no longer than that."""
    docs = S.load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("b", T.bound_text(F.col("t"), 100))
    cut = F.col("b").endswith(T.TRUNCATED) & (F.octet_length("b") <= 300)
    return docs.select("doc_id", F.when(F.col("b") == F.col("t"), F.octet_length("b")).cast("bigint").alias("whole"), cut.alias("cut"))


def community_nodes(spark, d):
    """Customers with meta data: a community by nation, one of another nation before, a label and a description."""
    base = S.load(spark, d, "customer")
    n, c = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    before = F.when(c % 3 == 0, F.concat(F.lit("c-"), n)).when(c % 3 == 1, F.lit("c-old"))
    label = F.when(c % 2 == 0, F.lit("Given"))
    values = {"community": before, "communityLabel": label, "communityDescription": F.lit("told"), "communityPreviousId": F.lit("p"), "own": F.when(c % 5 == 0, "x")}
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit("")).alias("v")) for k, v in values.items()])
    meta = F.map_from_entries(F.filter(entries, lambda e: e["v"] != ""))
    nodes = base.select(F.concat(F.lit("customer://"), c).alias("id"), meta.alias("meta"))
    size = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey"))
    return nodes, base.select(F.concat(F.lit("customer://"), c).alias("id"), F.concat(F.lit("c-"), n).alias("community"), F.concat(F.lit("Nation "), n).alias("name"), size.alias("size"))


@query("community_meta_removed", "SELECT 'customer://' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'own=x' END AS meta FROM customer")
def community_meta_removed(spark, d):
    nodes = D.removed(community_nodes(spark, d)[0])
    return nodes.select("id", F.when(F.col("meta").isNotNull(), F.concat_ws(",", F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))).alias("meta"))


@query(
    "community_meta_stamped",
    """WITH s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT 'customer://' || c_custkey AS id, 'c-' || c_nationkey AS community, CAST(n AS VARCHAR) AS size,
    CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Given' ELSE 'Nation ' || c_nationkey END AS label, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE 'deterministic' END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN 'told' END AS description, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'p' END AS previous FROM customer JOIN s ON k = c_nationkey""",
)
def community_meta_stamped(spark, d):
    nodes = D.stamped(*community_nodes(spark, d), "balanced", 50)
    names = {"community": "community", "communitySize": "size", "communityLabel": "label", "communityLabelStatus": "status", "communityDescription": "description", "communityPreviousId": "previous"}
    return nodes.select("id", *[F.col("meta")[k].alias(v) for k, v in names.items()])


@query("community_descriptions", "SELECT 'customer://' || c_custkey AS id, CASE WHEN c_nationkey < 10 THEN 'About ' || c_nationkey END AS description FROM customer")
def community_descriptions(spark, d):
    """Communities of some nations described."""
    nodes, assigned = community_nodes(spark, d)
    own = D.stamped(D.removed(nodes), assigned, "balanced", 50)
    told = S.load(spark, d, "nation").filter("n_nationkey < 10").join(S.load(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    key = F.col("n_nationkey").cast("string")
    rows = told.select(F.concat(F.lit(" c-"), key).alias("community"), F.concat(F.lit("About "), key, F.lit(" ")).alias("description"), F.lit("seen").alias("rationale"))
    return D.described(own, rows, "test").select("id", F.col("meta")["communityDescription"].alias("description"))


@query(
    "shortlist_order",
    """WITH r AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS place FROM lineitem),
    n AS (SELECT r.*, p_type AS kind, p_size % 3 AS name FROM r JOIN part ON p_partkey = p), c AS (SELECT *, row_number() OVER (PARTITION BY k, kind, name ORDER BY place) > 2 AS late FROM n)
    SELECT k, p, place, CAST(row_number() OVER (PARTITION BY k ORDER BY late, place) - 1 AS BIGINT) AS shown FROM c""",
)
def shortlist_order(spark, d):
    """Parts of an order as candidates: the third of one kind and name stands behind all others."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")) - 1
    rows = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), place.cast("bigint").alias("place"))
    part = S.load(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("kind"), F.concat((F.col("p_size") % 3).cast("string"), F.lit("()")).alias("name"))
    both = rows.join(part, "p").withColumn("was", F.col("place"))
    return H.diversified(both, ["k"]).select("k", "p", F.col("was").alias("place"), F.col("place").cast("bigint").alias("shown"))


@query("limited_explanation", f"WITH {sql.RELATIONAL}, x AS (SELECT DISTINCT 0 AS o, 'out' AS direction, kind, dst AS id FROM edges WHERE src = 'nation://3' UNION ALL SELECT DISTINCT 1, 'in', kind, src FROM edges WHERE dst = 'nation://3') SELECT direction, x.kind, x.id FROM x JOIN nodes USING (id) ORDER BY o, x.kind, x.id LIMIT 12")
def limited_explanation(spark, d):
    return A.limited_neighbours(V.neighbours(S.relational_graph(spark, d), "nation://3"), 12).select("direction", "kind", "id")


@query("concrete_cycles", "SELECT 'n' || lpad(CAST(k AS VARCHAR), 3, '0') AS component, 'n' || lpad(CAST(k AS VARCHAR), 3, '0') || ' -> s' || lpad(CAST(k AS VARCHAR), 3, '0') || ' -> n' || lpad(CAST(k AS VARCHAR), 3, '0') AS cycle FROM (SELECT DISTINCT s_nationkey AS k FROM supplier)")
def concrete_cycles(spark, d):
    """Nations and a node of their suppliers depend on each other; suppliers on their nation, with no way back."""
    base = S.load(spark, d, "supplier")
    n, s = (F.concat(F.lit(c), F.lpad(F.col("s_nationkey").cast("string"), 3, "0")) for c in ("n", "s"))
    pairs = base.select(n.alias("src"), s.alias("dst")).union(base.select(s, n)).union(base.select(F.col("s_suppkey").cast("string"), n)).distinct()
    return A.concrete_cycles(pairs, A.strong_components(spark, pairs, stepper(spark)))


@query(
    "contributing_files",
    """SELECT 'src/' || doc_id AS path FROM documents WHERE doc_id % 4 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0""",
)
def contributing_files(spark, d):
    """Documents as files: of some a node stands in, of others evidence with and without a line."""
    docs = S.load(spark, d, "documents").select("doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("path"))
    none = F.lit(None).cast("string")
    told = lambda df, tail: df.select(none.alias("path"), F.create_map(F.lit("evidence"), F.concat("path", F.lit(tail))).alias("meta"))
    nodes = docs.filter("doc_id % 4 = 0").select("path", F.create_map(F.lit("a"), F.lit("b")).alias("meta")).unionByName(told(docs.filter("doc_id % 7 = 0"), ":12:3"))
    return A.contributing_files(docs, nodes, told(docs.filter("doc_id % 9 = 0"), "").unionByName(told(docs, "x:1")))


@query(
    "identifier_retrieval",
    """WITH i AS (SELECT l_orderkey AS "case", l_linenumber AS rank, 'N' || l_partkey % 40 AS name, 'a/lib/f' || l_suppkey % 30 || '.py' AS path FROM lineitem),
    g AS (SELECT o_orderkey AS "case", 'n' || k AS key, k, 'lib/f' || k || '.py' AS gold FROM orders, (VALUES (1), (2), (35)) v(k)),
    m AS (SELECT g."case", key, min(rank) AS rank FROM g JOIN i ON i."case" = g."case" AND (lower(name) = key OR path = 'a/' || gold) GROUP BY 1, 2), t AS (SELECT "case", min(rank) AS rank, count(*) AS n FROM m GROUP BY 1)
    SELECT o_orderkey AS "case", n IS NOT NULL AS hit, rank, CAST(round(coalesce(n / 3, 0) * 1000) AS BIGINT) AS recall FROM orders LEFT JOIN t ON t."case" = o_orderkey""",
)
def identifier_retrieval(spark, d):
    line = S.load(spark, d, "lineitem")
    items = line.select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("N"), F.col("l_partkey") % 40).alias("name"), F.concat(F.lit("./a/lib/f"), F.col("l_suppkey") % 30, F.lit(".py")).alias("path"))
    k = F.explode(F.array(*map(F.lit, (1, 2, 35))))
    gold = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("case"), k.alias("k")).select("case", F.concat(F.lit("n"), "k").alias("identifier"), F.array(F.concat(F.lit("/lib/f"), "k", F.lit(".py"))).alias("paths"))
    return E.identifiers(items, gold).select("case", "hit", "rank", F.round(F.col("recall") * 1000).cast("bigint").alias("recall"))


@query(
    "retrieval_funnel",
    """SELECT o_custkey AS "case", bool_or(o_orderkey % 5 = 0) AS ranked, bool_or(o_orderkey % 7 = 0) AS seeded, bool_or(o_orderkey % 3 = 0) AS traversed, bool_or(o_orderkey % 4 = 0) AS walked, false AS candidate, bool_or(o_orderkey % 11 = 0) AS returned,
    coalesce(string_agg(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, ',' ORDER BY CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END), '') AS dropped FROM orders GROUP BY 1""",
)
def retrieval_funnel(spark, d):
    rank = lambda n: F.when(F.col("o_orderkey") % n == 0, 3).otherwise(0)
    k = F.col("o_orderkey")
    traces = S.load(spark, d, "orders").select(F.col("o_custkey").alias("case"), rank(5).alias("lexical_rank"), (k % 7 == 0).alias("seeded"), (k % 3 == 0).alias("traversed"), rank(4).alias("walk_rank"), F.lit(None).cast("int").alias("candidate_rank"), rank(11).alias("returned_rank"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("dropped"))
    return E.funnel(traces).withColumn("dropped", F.array_join("dropped", ","))
