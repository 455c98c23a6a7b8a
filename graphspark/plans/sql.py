"""The graph and its text functions in SQL, from which the oracles are put together."""

from __future__ import annotations

NODES = """
SELECT 'region://' || r_regionkey AS id, 'domain' AS kind, r_name AS name, NULL::VARCHAR AS path, NULL::VARCHAR AS package FROM region
UNION ALL SELECT 'nation://' || n_nationkey, 'package', n_name, 'world/' || n_name, NULL FROM nation
UNION ALL SELECT 'customer://' || c_custkey, 'class', c_name, NULL, 'nation://' || c_nationkey FROM customer
UNION ALL SELECT 'supplier://' || s_suppkey, 'module', s_name, NULL, 'nation://' || s_nationkey FROM supplier
UNION ALL SELECT 'part://' || p_partkey, 'type', p_name, NULL, p_brand FROM part
UNION ALL SELECT 'order://' || o_orderkey, 'function', 'Order ' || o_orderkey, NULL, NULL FROM orders
"""

PAIRS = """
SELECT 'contains' AS kind, 'region://' || n_regionkey AS src, 'nation://' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'contains', 'nation://' || c_nationkey, 'customer://' || c_custkey FROM customer
UNION ALL SELECT 'contains', 'nation://' || s_nationkey, 'supplier://' || s_suppkey FROM supplier
UNION ALL SELECT 'defines', 'customer://' || o_custkey, 'order://' || o_orderkey FROM orders
UNION ALL SELECT DISTINCT 'calls', 'order://' || l_orderkey, 'part://' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'depends_on', 'part://' || l_partkey, 'supplier://' || l_suppkey FROM lineitem
"""

TEXT_NODES = """
SELECT DISTINCT 'src://' || source AS id, 'dir' AS kind, source AS name, source AS path, NULL::VARCHAR AS package FROM documents
UNION ALL SELECT 'document://' || doc_id, 'document', 'Document ' || doc_id, source || '/' || lang || '/' || doc_id, source FROM documents
UNION ALL SELECT 'page://' || page_id, 'document', url, url, NULL FROM pages
UNION ALL SELECT DISTINCT 'conv://' || conv_id, 'flow', 'Conversation ' || conv_id, NULL, NULL FROM conversations
UNION ALL SELECT 'turn://' || conv_id || '/' || turn, 'step', role, NULL, NULL FROM conversations
UNION ALL SELECT DISTINCT 'event_type://' || event_type, 'concept', event_type, NULL, NULL FROM events
UNION ALL SELECT DISTINCT 'user://' || user_id, 'step', 'User ' || user_id, NULL, NULL FROM events
"""

TEXT_PAIRS = """
SELECT 'contains' AS kind, 'src://' || source AS src, 'document://' || doc_id AS dst FROM documents
UNION ALL SELECT 'contains', 'conv://' || conv_id, 'turn://' || conv_id || '/' || turn FROM conversations
UNION ALL SELECT 'flows_to', 'turn://' || conv_id || '/' || turn, 'turn://' || conv_id || '/' || after
  FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE after IS NOT NULL
UNION ALL SELECT DISTINCT 'affects', 'event_type://' || event_type, 'user://' || user_id FROM events
"""

EDGE_ID = "kind || '://' || substr(sha1(kind || chr(0) || src || chr(0) || dst), 1, 24)"


def graph(nodes: str = NODES, pairs: str = PAIRS) -> str:
    return f"nodes AS MATERIALIZED ({nodes}), edges AS MATERIALIZED (SELECT {EDGE_ID} AS id, kind, src, dst FROM ({pairs}))"


RELATIONAL = graph()
TEXTUAL = graph(TEXT_NODES, TEXT_PAIRS)
FULL = graph(f"{NODES} UNION ALL {TEXT_NODES}", f"{PAIRS} UNION ALL {TEXT_PAIRS}")


def tokens(value: str) -> str:
    """Words of a text without East Asian letters."""
    cut = rf"regexp_replace(regexp_replace({value}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"list_filter(string_split(lower(regexp_replace({cut}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def listed(values) -> str:
    return "(" + strings(values)[1:-1] + ")"
