"""Further queries: communities, bounded context, reviews, evaluation, enrichment, sources."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import affected as AF
from ..operators import analytics as A
from ..operators import community as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import question as Q
from ..operators import retrieve as R
from ..operators import reviews as P
from ..sources import extract as X
from ..sources import jsonl as J
from ..sources import references as Y
from ..sources import scan as N
from ..sources import tables as S
from ..streaming.watch import watch
from . import sql
from .catalog import query
from .work import shared_folder, stepper

# --- communities ---------------------------------------------------------------------------

KNOWN = "v AS (SELECT e.* FROM edges e WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"
WEIGHT = f"(CASE WHEN kind IN {sql.listed(('calls', 'imports', 'depends_on', 'implements', 'references'))} THEN 3 ELSE 1 END * 1024)"


@query("edge_weights", f"WITH {sql.RELATIONAL} SELECT id, CAST({WEIGHT} AS BIGINT) AS weight FROM edges")
def edge_weights(spark, d):
    return S.relational_graph(spark, d).edges.select("id", C.edge_weight(F.col("kind")).alias("weight"))


DOWN = lambda w, k, t: f"CASE WHEN {k} > {t} THEN greatest(1, {w} * {t} // {k}) ELSE {w} END"


@query(
    "hub_downweight",
    f"""WITH {sql.RELATIONAL}, {KNOWN}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM v UNION ALL SELECT dst FROM v) GROUP BY id),
    a AS (SELECT src, dst, kind, {DOWN(WEIGHT, 's.k', 30)} AS w, t.k AS dk FROM v JOIN d s ON s.id = src JOIN d t ON t.id = dst) SELECT src, dst, kind, CAST({DOWN('w', 'dk', 30)} AS BIGINT) AS weight FROM a""",
)
def hub_downweight(spark, d):
    return C.weighted_edges(S.relational_graph(spark, d), 30)


def labelled(spark, d):
    """Nodes of the text graph under given labels: the source of a document, else the kind."""
    nodes = S.text_graph(spark, d).nodes
    return nodes.withColumn("label", F.coalesce("package", "kind"))


LABELLED = "l AS (SELECT id, kind, name, path, coalesce(package, kind) AS label FROM nodes)"


@query("community_ids_from_labels", f"WITH {sql.TEXTUAL}, {LABELLED} SELECT label, 'c-' || substr(sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)), 1, 8) AS community, count(*) AS n FROM l GROUP BY label")
def community_ids(spark, d):
    rows = labelled(spark, d)
    return C.stable_ids(rows.select("id", "label")).join(rows.select("id", "label"), "id").groupBy("label", "community").agg(F.count(F.lit(1)).alias("n"))


@query(
    "community_summaries",
    f"""WITH {sql.TEXTUAL}, {LABELLED}, k AS (SELECT label, kind, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, kind) AS r FROM k)
    SELECT label AS community, CAST(sum(n) AS BIGINT) AS size, string_agg(kind || ':' || n, ',' ORDER BY r) FILTER (WHERE r <= 3) AS kinds FROM r GROUP BY label""",
)
def community_summaries(spark, d):
    return C.summaries(labelled(spark, d).withColumnRenamed("label", "community"))


GROUPED = """g AS (SELECT *, CASE WHEN coalesce(path, '') = '' THEN '' WHEN kind IN ('dir', 'package', 'module') THEN string_split(path, '/')[1] WHEN NOT contains(path, '/') THEN 'root' ELSE string_split(path, '/')[1] END AS grp FROM l WHERE path IS NULL OR path NOT LIKE 'http%')"""


@query(
    "community_names",
    f"""WITH {sql.TEXTUAL}, {LABELLED}, {GROUPED}, vt AS (SELECT label, grp, sum(CASE WHEN kind IN ('dir', 'file', 'package', 'module') THEN 3 ELSE 1 END) AS n FROM g WHERE grp <> '' GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, grp) AS r FROM vt),
    pt AS (SELECT a.label, CASE WHEN b.grp <> 'root' AND b.n * 100 >= a.n * 70 THEN a.grp || ' + ' || b.grp ELSE a.grp END AS by_path FROM rk a LEFT JOIN rk b ON b.label = a.label AND b.r = 2 WHERE a.r = 1 AND a.grp <> 'root'),
    an AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, name) AS r FROM g WHERE kind IN ('package', 'module', 'class', 'interface', 'domain', 'flow') GROUP BY label, name),
    fs AS (SELECT label, arg_min(upper(kind[1]) || kind[2:] || ' · ' || name, id) AS alone FROM g GROUP BY label)
    SELECT fs.label AS community, coalesce(by_path, an.name, alone) AS label FROM fs LEFT JOIN pt USING (label) LEFT JOIN an ON an.label = fs.label AND an.r = 1""",
)
def community_names(spark, d):
    own = labelled(spark, d).filter("path IS NULL OR path NOT LIKE 'http%'")
    return C.names(own.withColumnRenamed("label", "community"))


def order_years(spark, d):
    """Two labelings of customers: by nation, and by nation with some moved on."""
    base = S.load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c"))
    before = base.select("id", F.concat(F.lit("n"), F.col("k").cast("string")).alias("community"))
    moved = F.when(F.col("c") % 10 < F.col("k") % 8, (F.col("k") + 1) % 25).otherwise(F.col("k"))
    after = base.select("id", F.concat(F.when(F.col("k") % 2 == 0, "n").otherwise("m"), moved.cast("string")).alias("community"))
    return before, after


OVERLAPS = """b AS (SELECT c_custkey AS id, 'n' || c_nationkey AS old FROM customer), a AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'n' ELSE 'm' END || CASE WHEN c_custkey % 10 < c_nationkey % 8 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS new FROM customer),
s AS (SELECT old, new, count(*) AS "both" FROM a JOIN b USING (id) GROUP BY ALL), o AS (SELECT old, count(*) AS n FROM b GROUP BY 1), w AS (SELECT new, count(*) AS n FROM a GROUP BY 1),
j AS (SELECT old, new, "both", o.n + w.n - "both" AS either FROM s JOIN o USING (old) JOIN w USING (new))"""


@query("jaccard_overlap", f'WITH {OVERLAPS} SELECT old, new, "both", either FROM j')
def jaccard_overlap(spark, d):
    return C.overlaps(*order_years(spark, d))


@query(
    "label_remap",
    f"""WITH {OVERLAPS}, e AS (SELECT * FROM j WHERE "both" * 5 >= either * 2), u AS (SELECT * FROM e WHERE new IN (SELECT new FROM e GROUP BY new HAVING count(*) = 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY CAST("both" AS DOUBLE) / either DESC, new) AS k FROM u)
    SELECT new, old, CASE WHEN old = new THEN 'stable' WHEN "both" * 10 >= either * 7 THEN 'remapped' ELSE 'provisional' END AS status, "both", either FROM r WHERE k = 1""",
)
def label_remap(spark, d):
    return C.remap(*order_years(spark, d))


@query("community_assign")
def community_assign(spark, d):
    return C.assign(S.text_graph(spark, d), stepper(spark), 50)


# --- bounded context -----------------------------------------------------------------------


@query("context_bfs")
def context_bfs(spark, d):
    return R.context(S.relational_graph(spark, d), ["customer://1", "supplier://2"], depth=3, max_nodes=100, step=stepper(spark))


@query("context_dfs")
def context_dfs(spark, d):
    return R.context(S.relational_graph(spark, d), ["customer://1", "supplier://2"], depth=3, max_nodes=100, depth_first=True, step=stepper(spark))


@query("affected_packed")
def affected_packed(spark, d):
    g = S.relational_graph(spark, d)
    walked = R.context(G.Graph(g.nodes, A.impact_edges(g)), ["supplier://1"], depth=2, direction="in", hub=-1, step=stepper(spark))
    return R.pack(walked, g.nodes, budget=1000)


@query("affinity_propagation_k3")
def affinity(spark, d):
    found = R.affinity(S.text_graph(spark, d), spark.createDataFrame([("src://src0",)], "id string"), step=stepper(spark))
    return found.select("id", F.round(F.col("affinity") * 1_000_000).cast("bigint").alias("millionths"))


# --- reviews -------------------------------------------------------------------------------


def order_files(spark, d):
    """Orders as requests, their parts as files; parts of a type and brand are a community."""
    files = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), F.concat(F.lit("./part/"), F.col("l_partkey").cast("string")).alias("path"))
    part = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))
    nodes = S.load(spark, d, "part").select(F.concat(F.lit("file://"), part).alias("id"), F.lit("file").alias("kind"), part.alias("path"), F.concat_ws("-", "p_type", "p_brand").alias("community"))
    return files, nodes


@query(
    "pr_conflicts",
    """WITH f AS (SELECT DISTINCT l_orderkey AS number, 'part/' || l_partkey AS path, p_type || '-' || p_brand AS community FROM lineitem JOIN part ON p_partkey = l_partkey),
    x AS (SELECT DISTINCT 'file' AS kind, path AS shared, number FROM f UNION ALL SELECT DISTINCT 'community', community, number FROM f)
    SELECT * FROM (SELECT kind, shared, count(*) OVER (PARTITION BY kind, shared) AS requests, number FROM x) WHERE requests > 1""",
)
def pr_conflicts(spark, d):
    """Who overlaps with whom: the requests by what they share."""
    return P.shared_by(P.mapped_files(*order_files(spark, d)))


@query(
    "pr_analysis",
    """WITH f AS (SELECT DISTINCT l_orderkey AS number, l_partkey AS part, p_type || '-' || p_brand AS community FROM lineitem JOIN part ON p_partkey = l_partkey),
    m AS (SELECT number, count(DISTINCT part) AS mapped, count(DISTINCT community) AS communities FROM f GROUP BY 1), c AS (SELECT l_orderkey AS number, count(DISTINCT l_partkey) AS changed FROM lineitem GROUP BY 1),
    x AS (SELECT a.number, count(DISTINCT b.number) AS others FROM f a JOIN f b USING (part) GROUP BY 1)
    SELECT o_orderkey AS number, CASE o_orderstatus WHEN 'F' THEN 'failing' WHEN 'P' THEN 'pending' ELSE 'passing' END AS ci, coalesce(changed, 0) AS changed, coalesce(mapped, 0) AS mapped, coalesce(communities, 0) AS communities, coalesce(2 * mapped + others, 0) AS affected
    FROM orders LEFT JOIN c ON c.number = o_orderkey LEFT JOIN m ON m.number = o_orderkey LEFT JOIN x ON x.number = o_orderkey""",
)
def pr_analysis(spark, d):
    """Orders as requests; each part is a file that defines it, and the orders that call it are affected."""
    files, nodes = order_files(spark, d)
    g = S.relational_graph(spark, d)
    held = nodes.select(F.lit("defines").alias("kind"), F.col("id").alias("src"), F.concat(F.lit("part://"), F.regexp_extract("path", "([0-9]+)$", 1)).alias("dst"))
    both = g.nodes.select("id", "kind", "path", F.lit("").alias("community")).unionByName(nodes.select("id", "kind", "path", "community"))
    edges = g.edges.filter("kind = 'calls'").select("id", "kind", "src", "dst").unionByName(S.with_ids(held).select("id", "kind", "src", "dst"))
    state = F.when(F.col("o_orderstatus") == "F", "FAILURE").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SUCCESS")
    check = F.struct(state.alias("state"), F.lit("").alias("status"), F.lit("").alias("conclusion"))
    requests = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.array(check).alias("checks"))
    return P.analyze(G.Graph(both, edges), requests, files, step=stepper(spark))


@query(
    "affected_targets",
    """SELECT 'supplier://' || s_suppkey AS target, 'supplier://' || s_suppkey AS id, 0 AS distance FROM supplier UNION ALL SELECT DISTINCT 'supplier://' || l_suppkey, 'part://' || l_partkey, 1 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    UNION ALL SELECT 'customer://' || c_custkey, 'customer://' || c_custkey, 0 FROM customer
    UNION ALL SELECT t, i, 0 FROM (SELECT 'customer://' || o_custkey AS t, 'order://' || o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY 'order://' || o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey) WHERE n <= 3""",
)
def affected_targets(spark, d):
    """What is one step away from each supplier and each customer, begun at three of their definitions too."""
    g = S.relational_graph(spark, d)
    targets = g.nodes.filter("id LIKE 'supplier://%' OR id LIKE 'customer://%'").select(F.col("id").alias("target"))
    return AF.affected(g, targets, depth=1, limit=4, step=stepper(spark))


def stored(spark, d):
    """The tables' graph, assembled once for the several readings of a question."""
    g, step = S.relational_graph(spark, d), stepper(spark)
    return G.Graph(step(g.nodes), step(g.edges))


@query("context_pack")
def context_pack(spark, d):
    """The context of a question, packed under a budget: nodes, then the edges that explain them."""
    found = Q.retrieve(stored(spark, d), "which small widget is called by Order 7", Q.Options(max_nodes=60, budget=1500), step=stepper(spark))
    return found.nodes.select(F.lit("node").alias("part"), "place", "id", "tokens").unionByName(found.edges.select(F.lit("edge").alias("part"), "place", "id", "tokens"))


@query("affected_pack")
def affected_pack(spark, d):
    """What depends on a supplier, packed under a budget."""
    return Q.affected_context(stored(spark, d), "supplier://1", Q.Options(depth=2, budget=1000), step=stepper(spark)).nodes.select("place", "id", "seed", "distance", "tokens")


CHECKS = "CASE l_linenumber % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'in_progress' WHEN 2 THEN '' WHEN 3 THEN 'requested' ELSE 'queued' END"


@query(
    "pr_ci_summary",
    f"""WITH s AS (SELECT l_orderkey AS number, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'startup_failure' ELSE 'success' END AS conclusion, {CHECKS} AS status, l_quantity > 45 AS none FROM lineitem)
    SELECT number, CASE WHEN bool_and(none) THEN 'unknown' WHEN bool_or(conclusion = 'startup_failure' AND NOT none) THEN 'failing' WHEN bool_or(status IN ('in_progress', 'queued') AND NOT none) THEN 'pending' ELSE 'passing' END AS status FROM s GROUP BY number""",
)
def pr_ci_summary(spark, d):
    """Lines of an order as its checks; lines of large quantity report none."""
    n = F.col("l_linenumber") % 5
    status = F.when(n == 0, "COMPLETED").when(n == 1, "in_progress").when(n == 2, "").when(n == 3, "requested").otherwise("queued")
    conclusion = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "startup_failure").otherwise("success")
    check = F.when(F.col("l_quantity") <= 45, F.struct(conclusion.alias("conclusion"), F.lit("").alias("state"), status.alias("status")))
    runs = S.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_list(check).alias("checks"))
    return runs.select("number", P.check_summary(F.col("checks")).alias("status"))


# --- evaluation ----------------------------------------------------------------------------


def cases(spark, d):
    """Orders as cases: expected are the parts with a discount, found are all in order."""
    line = S.load(spark, d, "lineitem").withColumn("p", F.concat(F.lit("part://"), F.col("l_partkey").cast("string")))
    by = line.groupBy(F.col("l_orderkey").cast("string").alias("id"), (F.col("l_orderkey") % 5).cast("string").alias("dataset"))
    rows = by.agg(F.collect_set(F.when(F.col("l_discount") > 0.05, F.col("p"))).alias("expected"), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "p"))), lambda x: x["p"]).alias("ids"))
    return rows.select("id", "dataset", "expected"), rows.select("id", "ids")


CASES = """k AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_orderkey % 5 AS VARCHAR) AS dataset, 'part://' || l_partkey AS p, l_discount > 0.05 AS want, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, 'part://' || l_partkey) AS place FROM lineitem),
w AS (SELECT DISTINCT id, p FROM k WHERE want), h AS (SELECT k.*, w.p IS NOT NULL AS hit FROM k LEFT JOIN w USING (id, p)),
sc AS (SELECT id, dataset, CASE WHEN count(DISTINCT p) FILTER (WHERE want) > 0 THEN count(*) FILTER (WHERE hit) / count(DISTINCT p) FILTER (WHERE want) ELSE 0 END AS recall,
  count(*) FILTER (WHERE hit) / count(*) AS precision, coalesce(1 / min(place) FILTER (WHERE hit), 0) AS reciprocal_rank FROM h GROUP BY id, dataset)"""
MILLI = lambda c: f"CAST(round({c} * 1000000) AS BIGINT) AS {c}"


@query("retrieval_scores", f"WITH {CASES} SELECT id, dataset, {MILLI('recall')}, {MILLI('precision')}, {MILLI('reciprocal_rank')} FROM sc")
def retrieval_scores(spark, d):
    found = E.score(*cases(spark, d))
    return found.select("id", "dataset", *[F.round(F.col(c) * 1_000_000).cast("bigint").alias(c) for c in ("recall", "precision", "reciprocal_rank")])


@query(
    "evaluation_aggregate",
    f"WITH {CASES} SELECT dataset, count(*) AS cases, CAST(round(avg(recall) * 10000) AS BIGINT) AS recall, CAST(round(avg(precision) * 10000) AS BIGINT) AS precision, CAST(round(avg(reciprocal_rank) * 10000) AS BIGINT) AS reciprocal_rank, CAST(round(quantile_disc(recall, 0.95) * 10000) AS BIGINT) AS recall_p95 FROM sc GROUP BY GROUPING SETS ((dataset), ())",
)
def evaluation_aggregate(spark, d):
    total = E.aggregate(E.score(*cases(spark, d)))
    return total.select("dataset", "cases", *[F.round(F.col(c) * 10_000).cast("bigint").alias(c) for c in ("recall", "precision", "reciprocal_rank", "recall_p95")])


@query("stale_expectations", f"WITH {sql.RELATIONAL}, x AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, 'part://' || l_partkey AS expected FROM lineitem WHERE l_discount > 0.05) SELECT id, expected FROM x WHERE expected NOT IN (SELECT id FROM nodes WHERE package <> 'Brand#1')")
def stale_expectations(spark, d):
    return E.stale(cases(spark, d)[0], S.relational_graph(spark, d).nodes.filter("package <> 'Brand#1'"))


@query("quality_gate", f"WITH {CASES}, m AS (SELECT avg(recall) AS r, avg(precision) AS p FROM sc) SELECT 'precision' AS metric, 0.99::DOUBLE AS minimum FROM m WHERE p < 0.99 UNION ALL SELECT 'recall', 0.01 FROM m WHERE r < 0.01")
def quality_gate(spark, d):
    overall = E.aggregate(E.score(*cases(spark, d))).filter("dataset IS NULL")
    return E.gate(overall, {"precision": 0.99, "recall": 0.01}).select("metric", "minimum")


SPANS = "sp AS (SELECT l_suppkey AS k, l_partkey % 500 AS s, l_partkey % 500 + l_linenumber AS e FROM lineitem)"


@query(
    "merged_intervals",
    f"""WITH {SPANS}, o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR lag(s) OVER (PARTITION BY k ORDER BY s, e) IS NULL THEN 1 ELSE 0 END AS n FROM sp),
    i AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT k, min(s) AS start, max(e) AS "end" FROM i GROUP BY k, g""",
)
def merged_intervals(spark, d):
    spans = S.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 500).alias("start"), (F.col("l_partkey") % 500 + F.col("l_linenumber")).alias("end"))
    return E.merge_intervals(spans, ["k"])


@query("enclosing_spans", "WITH sp AS (SELECT DISTINCT p_size AS k, p_partkey AS s, p_partkey + 40 + p_partkey % 7 AS e, 'part' || p_partkey AS name FROM part), pt AS (SELECT DISTINCT p_size AS k, p_partkey + 30 AS o FROM part) SELECT pt.k AS k, o AS \"offset\", arg_min(name, (e - s) * 1000000 + s) AS name FROM pt JOIN sp ON pt.k = sp.k AND s <= o AND o < e GROUP BY ALL")
def enclosing_spans(spark, d):
    part = S.load(spark, d, "part")
    spans = part.select(F.col("p_size").alias("k"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 40 + F.col("p_partkey") % 7).alias("end"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"))
    return E.enclosing(part.select(F.col("p_size").alias("k"), (F.col("p_partkey") + 30).alias("offset")).distinct(), spans, "k")


# --- enrichment ----------------------------------------------------------------------------


def fragment(spark, d):
    docs = S.load(spark, d, "documents")
    level = F.when(F.col("doc_id") % 20 == 0, "extracted").otherwise("inferred")
    meta = F.create_map(F.lit("confidence"), level, F.lit("evidence"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("text"))
    none = F.lit(None).cast("string")
    nodes = docs.select(F.concat(F.lit("note://"), F.col("doc_id").cast("string")).alias("id"), F.lit("concept").alias("kind"), F.lit("Note").alias("name"), none.alias("path"), none.alias("package"), meta.alias("meta"))
    edges = docs.select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), F.lit("explains").alias("kind"), F.concat(F.lit("note://"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("document://"), (F.col("doc_id") * 3).cast("string")).alias("dst"), F.create_map(F.lit("confidence"), F.lit("extracted"), F.lit("evidence"), F.lit("x")).alias("meta"))
    return nodes, edges


@query(
    "fragment_validate",
    """WITH f AS (SELECT doc_id FROM documents) SELECT 'note://' || doc_id AS id, 'extracted without evidence' AS problem FROM f WHERE doc_id % 20 = 0 AND doc_id % 3 = 0
    UNION ALL SELECT 'note://' || doc_id, 'inferred without rationale' FROM f WHERE doc_id % 20 <> 0 UNION ALL SELECT 'e' || doc_id, 'unknown end' FROM f WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)""",
)
def fragment_validate(spark, d):
    return I.violations(*fragment(spark, d), S.text_graph(spark, d).nodes)


@query("fragment_apply", "SELECT 'note://' || doc_id AS id, 'concept' AS kind, 'test' AS source FROM documents UNION ALL SELECT 'document://' || doc_id, 'document', NULL FROM documents")
def fragment_apply(spark, d):
    g = S.text_graph(spark, d)
    empty = F.create_map().cast("map<string,string>")
    own = G.Graph(g.nodes.filter("id LIKE 'document://%'").withColumn("meta", empty), g.edges.withColumn("meta", empty))
    nodes, edges = fragment(spark, d)
    return I.apply(own, nodes, edges, "test").nodes.select("id", "kind", F.col("meta")["source"].alias("source"))


# --- sources -------------------------------------------------------------------------------


SCAN_NAMES = (".env", "API-token.go", "go.sum", "a.min.js", "id.P8", "Gemfile.lock", "x.lock", "pass_word.py", "apitoken", "secretary.go", "my.secrets.yaml", "logo.PNG", "b.tgz", "c.db", "run.sh", "main.tf", "api.proto", "doc.rst", "App.vue", "n.hs", "Dockerfile", "makefile", "go.mod", "README")
SCAN_FOLDERS = ("src", "build", "node_modules", "x_cache", ".x_cache", "my_env", ".aws", "secrets", ".git/worktrees", "a/worktrees", "tmp")


def scan_entries(spark, d):
    """A tree of documents: files of odd names in folders of odd names, below their sources."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    folder = F.concat("source", F.lit("/"), pick(SCAN_FOLDERS, F.floor(F.col("doc_id") / len(SCAN_NAMES))))
    docs = S.load(spark, d, "documents").select(F.concat(folder, F.lit("/"), "doc_id", F.lit("/"), pick(SCAN_NAMES, F.col("doc_id"))).alias("path"), "text")
    rules = F.when(F.col("path").endswith("/README"), F.lit("*.txt\n/drop/**/x.go\n!keep.txt\ntmp/\n"))
    files = docs.select("path", F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), F.coalesce(rules, "text").alias("content"))
    marks = spark.createDataFrame([(".gitignore", "file", 9, "# c\n/src0/tmp/\n*.rst\n!src1/**/doc.rst\n")], "path string, kind string, size long, content string")
    dirs = files.select(F.explode(N.ancestors(F.col("path"))).alias("path")).filter("path <> ''").distinct().select("path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("content"))
    return files.unionByName(marks).unionByName(dirs).withColumn("modified_at", F.lit(None).cast("timestamp"))


def _scan_sql(ignored: bool) -> str:
    """Verdicts written out by hand for each name and folder."""
    names = ", ".join(f"'{n}'" for n in SCAN_NAMES)
    folders = ", ".join(f"'{f}'" for f in SCAN_FOLDERS)
    entry = f"""p AS (SELECT source, doc_id, [{names}][doc_id % {len(SCAN_NAMES)} + 1] AS name, [{folders}][(doc_id // {len(SCAN_NAMES)}) % {len(SCAN_FOLDERS)} + 1] AS folder, octet_length(encode(text)) AS size FROM documents),
    f AS (SELECT *, source || '/' || folder || '/' || doc_id || '/' || name AS path,
      CASE folder WHEN 'node_modules' THEN 'default ignored directory' WHEN '.x_cache' THEN 'cache directory' WHEN 'my_env' THEN 'default ignored directory' WHEN '.aws' THEN 'sensitive credential directory'
        WHEN 'secrets' THEN 'sensitive credential directory' WHEN '.git/worktrees' THEN 'default ignored directory' WHEN 'tmp' THEN CASE WHEN source = 'src0' THEN 'gitignored' END END AS shut,
      CASE name WHEN '.env' THEN 'secret-like environment file' WHEN 'API-token.go' THEN 'sensitive credential filename' WHEN 'go.sum' THEN 'generated dependency lockfile' WHEN 'a.min.js' THEN 'minified generated file'
        WHEN 'id.P8' THEN 'secret-like key material' WHEN 'Gemfile.lock' THEN 'generated dependency lockfile' WHEN 'x.lock' THEN 'lock file' WHEN 'apitoken' THEN 'sensitive credential filename'
        WHEN 'my.secrets.yaml' THEN 'sensitive credential filename' WHEN 'logo.PNG' THEN 'binary image' WHEN 'b.tgz' THEN 'archive' WHEN 'c.db' THEN 'database file'
        WHEN 'doc.rst' THEN CASE WHEN source <> 'src1' THEN 'gitignored' END WHEN 'n.hs' THEN 'unsupported file type' WHEN 'makefile' THEN 'unsupported file type' WHEN 'README' THEN 'unsupported file type' END AS own,
      CASE name WHEN 'pass_word.py' THEN 'python' WHEN 'secretary.go' THEN 'go' WHEN 'run.sh' THEN 'shell' WHEN 'main.tf' THEN 'terraform' WHEN 'api.proto' THEN 'protobuf' WHEN 'doc.rst' THEN 'documentation'
        WHEN 'App.vue' THEN 'vue' WHEN 'Dockerfile' THEN 'dockerfile' WHEN 'go.mod' THEN 'go' END AS language FROM p)"""
    if not ignored:
        return f"WITH {entry} SELECT path, language FROM f WHERE shut IS NULL AND own IS NULL AND size <= 50000"
    return f"""WITH {entry} SELECT path, coalesce(own, 'over max file size') AS reason FROM f WHERE shut IS NULL AND (own IS NOT NULL OR size > 50000)
    UNION ALL SELECT DISTINCT source || '/' || CASE WHEN folder LIKE '.git/%' THEN '.git' ELSE folder END || '/', shut FROM f WHERE shut IS NOT NULL UNION ALL SELECT '.gitignore', 'unsupported file type'"""


@query("scan_files", _scan_sql(False))
def scan_files(spark, d):
    return N.judge(scan_entries(spark, d), 50_000)[0].select("path", "language")


@query("scan_reasons", _scan_sql(True))
def scan_reasons(spark, d):
    return N.judge(scan_entries(spark, d), 50_000)[1]


@query("language_of_paths", "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'objective-c' WHEN 2 THEN 'dockerfile' WHEN 3 THEN 'ruby' WHEN 4 THEN 'shell' WHEN 5 THEN 'document' END AS language FROM part")
def language_of_paths(spark, d):
    part = S.load(spark, d, "part")
    s = F.col("p_size") % 7
    name = F.when(s == 0, "x.SUM").when(s == 1, "y.mm").when(s == 2, "Dockerfile").when(s == 3, "Core.PodSpec").when(s == 4, "a.b.zsh").when(s == 5, "t.odt").otherwise("dockerfile")
    return part.select("p_partkey", N.language(F.concat(F.lit("a.go/"), name)).alias("language"))


@query("page_links", r"SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*href=\"([^\"]*)\"', 1)) AS n FROM pages")
def page_links(spark, d):
    return S.load(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).cast("bigint").alias("n"))


@query(
    "markdown_outline",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '^#{1,6} +[^ #]')) AS sections,
      CAST(sum(len(regexp_extract_all(line, '\[[^\]]*\]\([^) \t>]+[^)]*\)')) - len(regexp_extract_all(line, '!\[[^\]]*\]\([^) \t>]+[^)]*\)'))) AS BIGINT) AS links FROM l GROUP BY doc_id""",
)
def markdown_outline(spark, d):
    """Sections and links of each document's text, zero where it has none; a test has fences and odd headings."""
    docs = S.load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    facts = X.markdown(docs).select("path", "fact").unionByName(docs.select("path", F.lit(None).cast("string").alias("fact")))
    return facts.groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(F.count_if(F.col("fact").startswith("section")).alias("sections"), F.count_if(F.col("fact") == "link").alias("links"))


def schema_files(spark, d):
    """A file of SQL for each supplier, in the folder of its nation: a table, a table that refers to the one before, a view and an index."""
    i = lambda shift=0: (F.col("s_suppkey") + shift).cast("string")
    text = F.concat(
        F.lit("CREATE TABLE shop.T"), i(), F.lit(" (id INT PRIMARY KEY, note TEXT DEFAULT 'x;y');\n-- CREATE TABLE gone (a INT);\nCREATE TABLE r"), i(),
        F.lit(" (t_id INT, FOREIGN KEY (t_id) REFERENCES t"), i(), F.lit(" (id), other INT REFERENCES r"), i(25), F.lit("(t_id));\nCREATE VIEW v"), i(),
        F.lit(" AS WITH c AS (SELECT 1) SELECT * FROM r"), i(), F.lit(" JOIN c ON true JOIN nowhere ON true;\nCREATE UNIQUE INDEX ix"), i(), F.lit(" ON shop.t"), i(), F.lit(" (id);"),
    )
    path = F.concat(F.lit("db/n"), F.col("s_suppkey") % 25, F.lit("/s"), F.lpad(i(), 9, "0"), F.lit(".sql"))
    return S.load(spark, d, "supplier").select(path.alias("path"), text.alias("text"))


SCHEMA_SQL = """f AS (SELECT s_suppkey AS i, 'db/n' || s_suppkey % 25 AS sc, 'db/n' || s_suppkey % 25 || '/s' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.sql' AS path FROM supplier),
n AS (SELECT DISTINCT 'schema://' || sc AS id, 'schema' AS kind, sc AS name FROM f UNION ALL SELECT 'table://' || sc || '#shop.t' || i, 'table', 'shop.t' || i FROM f UNION ALL SELECT 'table://' || sc || '#r' || i, 'table', 'r' || i FROM f
  UNION ALL SELECT 'view://' || sc || '#v' || i, 'view', 'v' || i FROM f UNION ALL SELECT 'index://' || sc || '#ix' || i || '#shop.t' || i, 'index', 'ix' || i FROM f
  UNION ALL SELECT 'column://table://' || sc || '#shop.t' || i || '#' || c, 'column', c FROM f, (VALUES ('id'), ('note')) v(c) UNION ALL SELECT 'column://table://' || sc || '#r' || i || '#' || c, 'column', c FROM f, (VALUES ('t_id'), ('other')) v(c)),
e AS (SELECT 'defines' AS kind, 'file://' || path AS src, 'schema://' || sc AS dst, '' AS how FROM f UNION ALL SELECT 'contains', 'schema://' || sc, 'table://' || sc || '#shop.t' || i, '' FROM f
  UNION ALL SELECT 'contains', 'schema://' || sc, 'table://' || sc || '#r' || i, '' FROM f UNION ALL SELECT 'contains', 'schema://' || sc, 'view://' || sc || '#v' || i, '' FROM f
  UNION ALL SELECT 'contains', 'table://' || sc || '#shop.t' || i, 'index://' || sc || '#ix' || i || '#shop.t' || i, '' FROM f
  UNION ALL SELECT 'contains', 'table://' || sc || '#shop.t' || i, 'column://table://' || sc || '#shop.t' || i || '#' || c, '' FROM f, (VALUES ('id'), ('note')) v(c)
  UNION ALL SELECT 'contains', 'table://' || sc || '#r' || i, 'column://table://' || sc || '#r' || i || '#' || c, '' FROM f, (VALUES ('t_id'), ('other')) v(c)
  UNION ALL SELECT 'references', 'table://' || sc || '#r' || i, 'table://' || sc || '#shop.t' || i, 'foreign_key' FROM f UNION ALL SELECT 'references', 'column://table://' || sc || '#r' || i || '#t_id', 'column://table://' || sc || '#shop.t' || i || '#id', 'foreign_key' FROM f
  UNION ALL SELECT 'references', 'table://' || sc || '#r' || i, 'table://' || sc || '#r' || (i + 25), 'foreign_key' FROM f WHERE i + 25 IN (SELECT i FROM f) UNION ALL SELECT 'references', 'column://table://' || sc || '#r' || i || '#other', 'column://table://' || sc || '#r' || (i + 25) || '#t_id', 'foreign_key' FROM f WHERE i + 25 IN (SELECT i FROM f)
  UNION ALL SELECT 'references', 'view://' || sc || '#v' || i, 'table://' || sc || '#r' || i, 'from' FROM f)"""


@query("sql_graph_nodes", f"WITH {SCHEMA_SQL} SELECT id, kind, name FROM n")
def sql_graph_nodes(spark, d):
    return X.sql_graph(X.sql(schema_files(spark, d)))[0].select("id", "kind", "name")


@query("sql_graph_edges", f"WITH {SCHEMA_SQL} SELECT kind, src, dst, how FROM e")
def sql_graph_edges(spark, d):
    return X.sql_graph(X.sql(schema_files(spark, d)))[1]


@query("workflow_schema", f"WITH {SCHEMA_SQL}, x AS (SELECT id FROM n) SELECT 'node' AS part, kind, id FROM n UNION ALL SELECT 'edge', kind, src || ' ' || dst || ' ' || how FROM e WHERE src IN (SELECT id FROM x) AND dst IN (SELECT id FROM x)")
def workflow_schema(spark, d):
    nodes, edges = X.sql_graph(X.sql(schema_files(spark, d)))
    named = edges.withColumn("id", F.concat_ws(" ", "src", "dst", "how"))
    found = A.workflow_view(G.Graph(nodes, named), "schema")
    return found.nodes.select(F.lit("node").alias("part"), "kind", "id").unionByName(found.edges.select(F.lit("edge").alias("part"), "kind", "id"))


DOC_SQL = """d AS (SELECT CAST(doc_id AS VARCHAR) || '.md' AS path, doc_id FROM documents)"""


@query(
    "markdown_graph_edges",
    f"""WITH {DOC_SQL} SELECT 'defines' AS kind, 'file://' || path AS src, 'document://' || path AS dst, 1 AS line FROM d UNION ALL SELECT 'contains', 'document://' || path, 'section://' || path || '#1', 1 FROM d
    UNION ALL SELECT 'contains', 'document://' || path, 'section://' || path || '#6', 6 FROM d UNION ALL SELECT 'cites', 'document://' || path, 'document-ref://' || (doc_id + 1) || '.md', 6 FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'cites', 'document://' || path, 'document-ref://other.md', 8 FROM d""",
)
def markdown_graph_edges(spark, d):
    """A page for each document: two headings (one indented), a fence with neither, links (one twice)."""
    docs = S.load(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[n]("), (F.col("doc_id") + 1).cast("string"), F.lit(".md)"))).otherwise("![i](x.png)")
    text = F.concat(F.lit("# Page "), i, F.lit("\n~~~\n# no [a](b.md)\n```\n~~~~\n   ## Next "), link, F.lit("\n####### seven\n[o](other.md) [o]( other.md )\n"))
    files = docs.select(F.concat(i, F.lit(".md")).alias("path"), text.alias("text"))
    return X.markdown_graph(X.markdown(files), files)[1].select("kind", "src", "dst", "line")


def source_tables(spark, d):
    """Parts as functions of fifty files, lines of orders as references to them, each file importing the next."""
    part, line = S.load(spark, d, "part"), S.load(spark, d, "lineitem")
    path = lambda n: F.concat(F.lit("src/f"), n.cast("string"), F.lit(".ts"))
    lang, none = F.lit("typescript").alias("language"), F.lit(None).cast("string")
    k = F.col("p_partkey")
    defs = part.select(path(F.col("p_size")).alias("path"), lang, F.lit("function").alias("kind"), F.concat(F.lit("n"), k % 700).alias("name"), none.alias("qualified"), (k * 10).alias("start"), (k * 10 + 10).alias("end"), k.cast("int").alias("line"), none.alias("role"), F.lit(False).alias("partial"))
    refs = line.select(path(F.col("l_suppkey") % 50 + 1).alias("path"), lang, F.when(F.col("l_linestatus") == "O", "calls").otherwise("references").alias("kind"), F.concat(F.lit("x.n"), F.col("l_partkey") % 900).alias("name"), F.when(F.col("l_returnflag") == "R", "x").alias("receiver"), (F.col("l_orderkey") * 3).alias("start"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("col"))
    files = part.select(path(F.col("p_size")).alias("path")).distinct()
    uses = part.select("p_size").distinct().select(path(F.col("p_size")).alias("path"), lang, F.concat(F.lit("./../src/f"), F.col("p_size") + 1).alias("name"), none.alias("source"), F.lit("import").alias("kind"), none.alias("alias"), F.lit(1).alias("line"))
    heritage = part.filter("p_size <= 50").select(path(F.col("p_size")).alias("path"), lang, F.concat(F.lit("n"), k % 700).alias("name"), F.concat(F.lit("n"), (k * 7) % 700).alias("parent"), k.cast("int").alias("line"), F.lit(1).alias("col"))
    return defs, refs, uses, heritage, files


SOURCE_SQL = """d AS (SELECT 'src/f' || p_size || '.ts' AS path, 'n' || p_partkey % 700 AS key, p_partkey AS k, count(*) OVER (PARTITION BY p_size, p_partkey % 700) AS n, row_number() OVER (PARTITION BY p_size, p_partkey % 700 ORDER BY p_partkey) AS r FROM part),
df AS (SELECT path, key, k, 'tree-symbol://typescript#' || path || '#function#' || key || CASE WHEN n > 1 THEN '#overload-' || r ELSE '' END AS id FROM d),
im AS (SELECT DISTINCT 'src/f' || p_size || '.ts' AS path, 'src/f' || (p_size + 1) || '.ts' AS target FROM part WHERE p_size + 1 IN (SELECT p_size FROM part)),
sf AS (SELECT path, key, count(*) AS n, min(id) AS id FROM df GROUP BY ALL), mf AS (SELECT im.path, key, count(*) AS n, min(id) AS id FROM im JOIN df ON df.path = target GROUP BY ALL), al AS (SELECT key, count(*) AS n, min(id) AS id FROM df GROUP BY ALL)"""


@query(
    "reference_resolution",
    f"""WITH {SOURCE_SQL}, r AS (SELECT 'src/f' || (l_suppkey % 50 + 1) || '.ts' AS path, CASE WHEN l_linestatus = 'O' THEN 'calls' ELSE 'references' END AS kind, 'n' || l_partkey % 900 AS key, l_returnflag = 'R' AS recv, l_orderkey * 3 AS pos, l_linenumber AS line, l_orderkey AS col FROM lineitem),
    x AS (SELECT r.*, sf.n AS sn, sf.id AS si, mf.n AS mn, mf.id AS mi, CASE WHEN recv AND kind = 'calls' THEN NULL ELSE al.n END AS an, al.id AS ai, c.id AS caller FROM r LEFT JOIN sf USING (path, key) LEFT JOIN mf USING (path, key) LEFT JOIN al USING (key) LEFT JOIN df c ON c.path = r.path AND pos >= c.k * 10 AND pos < c.k * 10 + 10),
    y AS (SELECT *, CASE WHEN sn > 0 THEN CASE WHEN sn = 1 THEN si END WHEN mn > 0 THEN CASE WHEN mn = 1 THEN mi END WHEN an = 1 THEN ai END AS hit, CASE WHEN sn > 0 THEN 'same file' WHEN mn > 0 THEN 'imported file' ELSE 'language' END AS scope FROM x)
    SELECT kind, coalesce(caller, 'file://' || path) AS src, coalesce(hit, 'tree-unresolved-' || CASE WHEN kind = 'calls' THEN 'call' ELSE 'reference' END || '://typescript#' || path || '#' || line || '#' || col || '#x.' || key) AS dst, CASE WHEN hit IS NOT NULL THEN scope END AS scope FROM y""",
)
def reference_resolution(spark, d):
    defs, refs, uses, _, files = source_tables(spark, d)
    own = Y.definitions(defs)
    return Y.resolve_references(refs, own, Y.names(own, Y.imports(uses, files))).select("kind", "src", "dst", "scope")


@query(
    "heritage_resolution",
    f"""WITH {SOURCE_SQL}, h AS (SELECT 'src/f' || p_size || '.ts' AS path, 'n' || p_partkey % 700 AS child, 'n' || (p_partkey * 7) % 700 AS key, p_partkey AS line FROM part),
    x AS (SELECT h.*, c.id AS src, sf.n AS sn, sf.id AS si, mf.n AS mn, mf.id AS mi, al.n AS an, al.id AS ai FROM h JOIN sf c ON c.path = h.path AND c.key = child AND c.n = 1 LEFT JOIN sf ON sf.path = h.path AND sf.key = h.key LEFT JOIN mf ON mf.path = h.path AND mf.key = h.key LEFT JOIN al ON al.key = h.key),
    y AS (SELECT *, CASE WHEN sn > 0 THEN CASE WHEN sn = 1 THEN si END WHEN mn > 0 THEN CASE WHEN mn = 1 THEN mi END WHEN an = 1 THEN ai END AS hit FROM x)
    SELECT src, coalesce(hit, 'tree-unresolved-type://typescript#' || path || '#' || line || '#1#' || key) AS dst, hit IS NOT NULL AS resolved FROM y""",
)
def heritage_resolution(spark, d):
    defs, _, uses, heritage, files = source_tables(spark, d)
    own = Y.definitions(defs)
    return Y.resolve_heritage(heritage, own, Y.names(own, Y.imports(uses, files))).select("src", "dst", "resolved")


@query("import_resolution", f"WITH {SOURCE_SQL} SELECT DISTINCT 'file://src/f' || p_size || '.ts' AS src, CASE WHEN p_size + 1 IN (SELECT p_size FROM part) THEN 'file://src/f' || (p_size + 1) || '.ts' ELSE 'tree-import://typescript#./../src/f' || (p_size + 1) END AS dst FROM part")
def import_resolution(spark, d):
    _, _, uses, _, files = source_tables(spark, d)
    return Y.import_edges(Y.imports(uses, files)).select("src", "dst")


@query("overload_ordinals", f"WITH {SOURCE_SQL} SELECT id, CAST(k AS BIGINT) AS k FROM df")
def overload_ordinals(spark, d):
    return Y.definitions(source_tables(spark, d)[0]).select("id", (F.col("start") / 10).cast("bigint").alias("k"))


@query(
    "strict_lines",
    """SELECT doc_id AS line, CASE doc_id % 7 WHEN 1 THEN 'unknown field ''x''' WHEN 2 THEN 'duplicate field ''id''' WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'expectedNodeIds contains duplicate value ''a'''
    WHEN 5 THEN 'requires id, dataset, question, and expectedNodeIds or expectedEvidence' ELSE 'duplicate id c' || (doc_id - 6) END AS problem FROM documents WHERE doc_id % 7 BETWEEN 1 AND 5 OR (doc_id % 7 = 6 AND doc_id - 6 IN (SELECT doc_id FROM documents))""",
)
def strict_lines(spark, d):
    """Evaluation cases as lines, six of seven wrong in a way of their own."""
    n, i = F.col("doc_id") % 7, F.col("doc_id")
    line = lambda name, rest, question="q": F.concat(F.lit('{"id": "c'), name.cast("string"), F.lit(f'", "dataset": "d", "question": "{question}", {rest}}}'))
    good = '"expectedNodeIds": ["a", "b"]'
    value = F.when(n == 1, line(i, good + ', "x": 1')).when(n == 2, line(i, good + ', "id": "z"')).when(n == 3, F.lit('{"id": ')).when(n == 4, line(i, '"expectedNodeIds": ["a", "a"]'))
    value = value.when(n == 5, line(i, good, " ")).when(n == 6, line(i - 6, good)).otherwise(line(i, good))
    rows = S.load(spark, d, "documents").select(i.alias("line"), value.alias("value"))
    return J.read(rows, J.CASES)[1].select("line", "problem")


@query("sql_lineage", "SELECT 'v' || s_suppkey AS object, CASE WHEN s_suppkey % 2 = 0 THEN 'shop.t' || s_suppkey ELSE 'other' END AS target, s_suppkey % 2 = 0 AS resolved FROM supplier")
def sql_lineage(spark, d):
    n = F.col("s_suppkey").cast("string")
    ddl = F.concat(F.lit("CREATE TABLE shop.T"), n, F.lit(" (id INT PRIMARY KEY, note TEXT DEFAULT 'x;y');\n-- from nowhere\nCREATE VIEW v"), n, F.lit(" AS WITH c AS (SELECT 1) SELECT * FROM "), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("t"), n)).otherwise("other"), F.lit(" JOIN c ON true;"))
    facts = X.sql(S.load(spark, d, "supplier").select(n.alias("path"), ddl.alias("text")))
    return X.resolve(facts).select("object", "target", "resolved")


@query("watch_changes", "SELECT 'changed' AS change, count(*) FILTER (WHERE doc_id % 4 = 1) AS n FROM documents UNION ALL SELECT 'removed', count(*) FILTER (WHERE doc_id % 4 = 0) FROM documents")
def watch_changes(spark, d):
    """Two scans follow each other as a stream; the changes of the second come out."""
    folder = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    docs = S.load(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    docs.select("path", "hash", F.lit(0).cast("bigint").alias("revision")).coalesce(1).write.parquet(f"{folder}/in/0")
    stream = lambda: watch(spark, f"{folder}/in/*", f"{folder}/state", f"{folder}/log")
    stream().awaitTermination()
    second = docs.filter("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 4 == 1, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")).alias("hash"), F.lit(1).cast("bigint").alias("revision"))
    second.coalesce(1).write.parquet(f"{folder}/in/1")
    stream().awaitTermination()
    return spark.read.parquet(f"{folder}/state/changes-1").groupBy("change").agg(F.count(F.lit(1)).alias("n"))



