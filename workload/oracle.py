"""The registered queries' results as SQL for DuckDB over the same tables."""

from __future__ import annotations

from chronoweave.operators.text_index import BM25_B, BM25_K1
from chronoweave.operators.vectors import SCORE_DIGITS
from workload.queries import AS_OF, CACHE_TTL, KNOWN, NOW

TOKEN_BREAK = r"[^\pL\pN]+"


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN ''"
        f" ELSE strftime({ts}, '.%f') END || '+00:00'"
    )


def after_epoch(n: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS BIGINT)))"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{TOKEN_BREAK}'), lambda w: w <> '')"


def sid(*parts: str) -> str:
    """The library's stable id: every part with its length, '-' for null."""
    return "sha256(" + " || '|' || ".join(f"coalesce(length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


# --- the input views
EVENT_CONTENT = {
    "json_ep": "props",
    "text_ep": """CASE event_type
        WHEN 'purchase' THEN 'I like item ' || k || '. I prefer item ' || k || ' over basic.'
        WHEN 'view' THEN 'I don''t like item ' || k || '.'
        WHEN 'error' THEN 'We need fix ' || k || '. Fix ' || k || ' is required.'
        WHEN 'click' THEN 'First do ' || k || ', then do ship.'
        ELSE 'If signup occurs, then do welcome.' END""",
    "struct_ep": """CASE event_type
        WHEN 'purchase' THEN '{"name": "u' || user_id || '", "type": "purchase", "confidence": ' || value || '}'
        WHEN 'signup' THEN '{"name": "u' || user_id || '", "type": "signup", "confidence": "' || value || '"}'
        WHEN 'view' THEN props
        WHEN 'click' THEN 'text ' || props
        ELSE '{"invalid": json' END""",
}
V: dict[str, str] = {
    "ev": "SELECT *, json_extract_string(props, '$.k') AS k FROM events",
    **{
        name: f"""SELECT 'ev-' || event_id AS uuid, event_type AS name, {content} AS content,
            CAST(user_id AS VARCHAR) AS group_id, ts AS reference_time, event_type, user_id, value, k FROM ev"""
        for name, content in EVENT_CONTENT.items()
    },
    "conv": """SELECT conv_id, string_agg(coalesce(role, 'user') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS content,
            count(*) AS n_turns FROM conversations GROUP BY conv_id""",
    "msg_ep": f"""SELECT 'conv-' || conv_id AS uuid, 'conversation' AS name, content, 'message' AS source, 'chat' AS source_description,
            'g' || n_turns AS group_id, {after_epoch("conv_id")} AS reference_time FROM conv""",
    "node": f"""SELECT CAST(p_partkey AS VARCHAR) AS uuid, p_name AS name, p_type || ' ' || p_brand AS summary, p_type AS label,
            p_brand AS group_id, {after_epoch("p_partkey")} AS created_at, p_size, CAST(embedding AS DOUBLE[]) AS v
            FROM part LEFT JOIN embeddings ON vec_id = p_partkey""",
    "q": """SELECT CAST(n_nationkey AS BIGINT) AS query_id, p_name AS text, CAST(embedding AS DOUBLE[]) AS v
            FROM nation JOIN part ON p_partkey = n_nationkey JOIN embeddings ON vec_id = n_nationkey""",
    "ent0": """SELECT 'c:' || c_custkey AS uuid, c_name AS name, 'buys ' || c_mktsegment AS summary, 'customer' AS group_id, c_custkey AS k FROM customer
            UNION ALL SELECT 's:' || s_suppkey, s_name, 'sells parts', 'supplier', s_suppkey FROM supplier
            UNION ALL SELECT 'n:' || n_nationkey, n_name, 'a nation', 'nation', n_nationkey FROM nation
            UNION ALL SELECT 'r:' || r_regionkey, r_name, 'a region', 'region', r_regionkey FROM region""",
    "ent": "SELECT ent0.*, CAST(embedding AS DOUBLE[]) AS v FROM ent0 LEFT JOIN embeddings ON vec_id = k",
    "edge0": """SELECT 'c:' || c_custkey || '>lives_in' AS uuid, 'c:' || c_custkey AS src, 'n:' || n_nationkey AS dst, 'lives_in' AS name,
                c_name || ' lives in ' || n_name AS fact, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey
            UNION ALL SELECT 's:' || s_suppkey || '>based_in', 's:' || s_suppkey, 'n:' || n_nationkey, 'based_in',
                s_name || ' based in ' || n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
            UNION ALL SELECT 'n:' || n_nationkey || '>part_of', 'n:' || n_nationkey, 'r:' || r_regionkey, 'part_of',
                n_name || ' part of ' || r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "edge": f"""SELECT edge0.*, {after_epoch("k")} AS valid_at, CAST(embedding AS DOUBLE[]) AS v
            FROM edge0 LEFT JOIN embeddings ON vec_id = k AND name = 'lives_in'""",
    "asked": """SELECT 's:' || s_suppkey || '>based_in' AS uuid FROM supplier
            UNION ALL SELECT 's:' || s_suppkey || '>lives_in' FROM supplier""",
    "fact": """SELECT 'ev-' || event_id AS uuid, 'g' AS group_id, CAST(user_id AS VARCHAR) AS source_node_uuid,
            'b' || CAST(floor(value / 50) AS BIGINT) AS target_node_uuid, event_type AS name, ts AS valid_at,
            ts + INTERVAL 1 HOUR AS created_at FROM events""",
    "centered": """SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'buys machinery supplier based in ' || n_name AS text,
            CAST(embedding AS DOUBLE[]) AS v, 'n:' || n_nationkey AS center FROM nation JOIN embeddings ON vec_id = n_nationkey""",
    "links": "SELECT src AS a, dst AS b FROM edge UNION ALL SELECT dst, src FROM edge",
    # breadth first from every nation, three hops
    "h0": "SELECT 'n:' || n_nationkey AS center, 'n:' || n_nationkey AS node, 0 AS d FROM nation",
    **{
        f"h{i}": f"""SELECT center, node, min(d) AS d FROM (SELECT * FROM h{i - 1} UNION ALL
            SELECT center, b, d + 1 FROM h{i - 1} JOIN links ON node = a) GROUP BY center, node"""
        for i in (1, 2, 3)
    },
    "said": """SELECT user_id, event_id, event_type, k, CASE WHEN event_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS role,
            event_id % 2 = 1 AS odd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn FROM ev""",
    # what the rules find: (user_id, turn, role, label, name, attributes)
    "found": """SELECT user_id, turn, role, 'Preference' AS label, name, 'category=' || category || ',description=' || name || ',polarity=' || polarity AS attributes FROM (
            SELECT user_id, turn, role, CASE WHEN odd THEN 'album ' ELSE 'tea ' END || k AS name, CASE WHEN odd THEN 'Music' ELSE 'Food' END AS category, 1 AS polarity FROM said WHERE event_type = 'purchase'
            UNION ALL SELECT user_id, turn, role, 'basic', 'other', -1 FROM said WHERE event_type = 'purchase' AND NOT odd
            UNION ALL SELECT user_id, turn, role, CASE WHEN odd THEN 'label ' ELSE 'song ' END || k, CASE WHEN odd THEN 'Brands' ELSE 'Music' END, -1 FROM said WHERE event_type = 'view')
        UNION ALL SELECT user_id, turn, role, 'Requirement', d, 'description=' || d || coalesce(',priority=' || priority, '') || ',project_name=@' FROM (
            SELECT user_id, turn, role, CASE WHEN odd THEN 'Audit ' ELSE 'critical fix ' END || k AS d, CASE WHEN NOT odd THEN 'critical' END AS priority FROM said WHERE event_type = 'error'
            UNION ALL SELECT user_id, turn, role, 'Login ' || k || ' must have high priority check', 'high' FROM said WHERE event_type = 'signup' AND odd)
        UNION ALL SELECT user_id, turn, role, 'Procedure', d, 'description=' || d || coalesce(',trigger=' || t, '') FROM (
            SELECT user_id, turn, role, CASE WHEN odd THEN 'Always check ' || k || ' when rain happens' ELSE 'First do ' || k || ', then do ship' END AS d,
                CASE WHEN odd THEN 'rain' END AS t FROM said WHERE event_type = 'click'
            UNION ALL SELECT user_id, turn, role, 'If signup occurs, then do welcome ' || k, 'signup' FROM said WHERE event_type = 'signup' AND NOT odd)""",
    "life": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id AS id,
            CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS event,
            'failed with ' || props AS message FROM events WHERE event_type IN ('signup', 'purchase', 'error')""",
}


def bm25(name: str, corpus: str, id: str, text: str, queries: str, k: int, where: str = "true") -> dict[str, str]:
    """Views ending in `name` (query_id, uuid, score, rank)."""
    p = f"{name}_"
    return {
        f"{p}doc": f"SELECT {id} AS uuid, {words(text)} AS ws, {where} AS allowed FROM {corpus}",
        f"{p}tf": f"""SELECT uuid, term, count(*) AS tf, any_value(dl) AS dl, any_value(allowed) AS allowed
            FROM (SELECT uuid, allowed, len(ws) AS dl, unnest(ws) AS term FROM {p}doc) GROUP BY uuid, term""",
        f"{p}df": f"SELECT term, count(*) AS df FROM {p}tf GROUP BY term",
        f"{p}st": f"SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM {p}doc",
        f"{p}qt": f"SELECT DISTINCT query_id, unnest({words('text')}) AS term FROM {queries}",
        f"{p}s": f"""SELECT query_id, uuid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({BM25_K1} + 1)
                / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * dl / avgdl))), {SCORE_DIGITS}) AS score
            FROM {p}qt JOIN {p}df USING (term) JOIN {p}tf USING (term) CROSS JOIN {p}st WHERE allowed GROUP BY query_id, uuid""",
        name: ranked(f"{p}s", "score DESC", k),
    }


def cosine(name: str, corpus: str, queries: str, k: int, where: str = "true") -> dict[str, str]:
    score = f"round(list_cosine_similarity(c.v, q.v), {SCORE_DIGITS})"
    return {
        f"{name}_s": f"SELECT query_id, uuid, {score} AS score FROM {corpus} c, {queries} q WHERE c.v IS NOT NULL AND {where}",
        name: ranked(f"{name}_s", "score DESC", k),
    }


def ranked(source: str, order: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, uuid) AS rank FROM {source})
        WHERE rank <= {k}"""


def fused(name: str, lists: list[str]) -> dict[str, str]:
    union = " UNION ALL ".join(f"SELECT query_id, uuid, rank FROM {x}" for x in lists)
    return {name: f"SELECT query_id, uuid, round(sum(1.0::DOUBLE / (60 + rank)), {SCORE_DIGITS}) AS rrf FROM ({union}) GROUP BY query_id, uuid"}


def hybrid(name: str, corpus: str, text: str, queries: str, limit: int, where: str = "true") -> dict[str, str]:
    return {
        **bm25(f"{name}t", corpus, "uuid", text, queries, 2 * limit, where),
        **cosine(f"{name}v", corpus, queries, 2 * limit, where),
        **fused(name, [f"{name}t", f"{name}v"]),
    }


ORACLE: dict[str, str] = {}


def check(query: str, sql: str, views: list[str] | None = None, extra: dict[str, str] | None = None, recursive: bool = False) -> None:
    """Registers `sql` with the views it names, in their order of definition."""
    ctes = {n: V[n] for n in V if n in (views or [])} | (extra or {})
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({s})" for n, s in ctes.items()) if ctes else ""
    ORACLE[query] = f"{head} {sql}"


# --- A
check(
    "a1_read_episodes",
    f"""SELECT uuid, name, content, 'json' AS source, 'event log' AS source_description, group_id,
        {iso("reference_time")} AS reference_time, fmt FROM json_ep, (VALUES ('json'), ('parquet')) f(fmt)""",
    ["ev", "json_ep"],
)
check(
    "a2_normalize_episodes",
    f"""SELECT CASE WHEN event_type = 'click' THEN {sid("group_id", "name", "epoch_us(t)", "content")}
            ELSE 'ev-' || event_id END AS uuid, name, content, source, source_description, group_id,
            {iso("t")} AS reference_time, {iso(f"TIMESTAMP '{NOW}'")} AS created_at FROM m""",
    extra={
        "m": f"""SELECT event_id, event_type, event_type AS name, 'event ' || event_id || ' ' || props AS content,
            CASE event_type WHEN 'view' THEN 'json' WHEN 'click' THEN 'message' ELSE 'text' END AS source,
            CASE event_type WHEN 'view' THEN '' ELSE 'log' END AS source_description,
            CASE event_type WHEN 'error' THEN 'default' WHEN 'signup' THEN '' ELSE CAST(user_id AS VARCHAR) END AS group_id,
            CASE event_type WHEN 'purchase' THEN TIMESTAMP '{NOW}' ELSE ts END AS t FROM events"""
    },
)
check(
    "a3_graph_round_trip",
    f"""SELECT 'entities' AS kind, uuid, group_id, name AS body FROM ent UNION ALL
        SELECT 'facts', uuid, name, fact FROM edge UNION ALL
        SELECT 'episodes', uuid, group_id, content FROM json_ep UNION ALL
        SELECT 'mentions', uuid, group_id, '' FROM json_ep UNION ALL
        SELECT DISTINCT 'postings', uuid, group_id, unnest({words("name || ' ' || summary")}) FROM ent""",
    ["ev", "json_ep", "ent0", "ent", "edge0", "edge"],
)
check(
    "a4_queue_position",
    """SELECT uuid, group_id, position, 'Episode ''' || name || ''' queued for processing (position: ' || position || ')' AS message
        FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reference_time, uuid) AS position FROM json_ep)""",
    ["ev", "json_ep"],
)
check("a4_queue_position_hot", ORACLE["a4_queue_position"])
check(
    "a5_upsert_entities",
    f"""SELECT uuid, CASE group_id WHEN 'supplier' THEN '2 ' || name ELSE name END AS name, group_id,
        {iso(f"({after_epoch('k')} + CASE group_id WHEN 'supplier' THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END)")} AS created_at,
        upper(left(group_id, 1)) || substr(group_id, 2) AS labels, 'key=' || k AS attributes,
        CAST(CASE WHEN v IS NULL THEN NULL ELSE len(v) END AS BIGINT) AS dim FROM ent""",
    ["ent0", "ent"],
)
check(
    "a5_upsert",
    """SELECT uuid, name, CASE WHEN p_size >= 45 THEN 'large ' || label ELSE summary END AS summary, group_id FROM node
        UNION ALL SELECT 's:' || s_suppkey, s_name, 'sells parts', 'supplier' FROM supplier""",
    ["node"],
)

# --- B
check(
    "b1_project_node_result",
    f"SELECT uuid, name, summary, label AS labels, group_id, {iso('created_at')} AS created_at, 'size=' || p_size AS attributes FROM node",
    ["node"],
)
check(
    "b2_format_fact",
    f"""SELECT uuid, name AS group_id, src AS source_node_uuid, dst AS target_node_uuid, name, fact, 'ep-' || k AS episodes,
        {iso("valid_at + INTERVAL 1 HOUR")} AS created_at, CAST(NULL AS VARCHAR) AS expired_at, {iso("valid_at")} AS valid_at,
        CAST(NULL AS VARCHAR) AS invalid_at, 'key=' || k AS attributes FROM edge""",
    ["edge0", "edge"],
)
check(
    "b3_episodes_to_json",
    f"""SELECT uuid, name, content, source, source_description, group_id, {iso("reference_time")} AS reference_time,
        {iso("reference_time")} AS created_at FROM msg_ep""",
    ["conv", "msg_ep"],
)
check(
    "b4_iso_utc",
    f"SELECT 'o' || o_orderkey AS id, {iso('o_orderdate')} AS iso FROM orders UNION ALL SELECT 'e' || event_id, {iso('ts')} FROM events",
)
check(
    "b5_normalize_urls",
    """SELECT native_url, min(page_id) AS first_id, count(*) AS n,
        starts_with(native_url, 'http://') OR starts_with(native_url, 'https://') AS has_http_scheme
        FROM (SELECT page_id, regexp_replace(replace(url || ending, '/v1', ''), '/+$', '') AS native_url
              FROM pages, (VALUES (''), ('/v1'), ('/v1/'), ('//')) e(ending)) GROUP BY native_url""",
)
check(
    "b6_clean_columns",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 0.5::DOUBLE ELSE value END AS as_float,
        CASE WHEN event_type = 'click' THEN -1 ELSE CAST(k AS BIGINT) END AS as_int,
        event_type <> 'error' AS as_bool, CASE WHEN event_type = 'error' THEN 'blank' ELSE event_type END AS as_text FROM ev""",
    ["ev"],
)
check(
    "b6_fallback_counts",
    """SELECT 'as_float' AS column_name, count(*) FILTER (event_type = 'view') AS fallbacks FROM events
        UNION ALL SELECT 'as_int', count(*) FILTER (event_type = 'click') FROM events
        UNION ALL SELECT 'as_bool', count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'error')) FROM events
        UNION ALL SELECT 'as_text', count(*) FILTER (event_type = 'error') FROM events""",
)

# --- C
check(
    "c1_filter_groups",
    """SELECT uuid, group_id, 'named' AS form FROM node WHERE group_id IN ('Brand#2', 'Brand#17')
        UNION ALL SELECT uuid, group_id, 'all' FROM node
        UNION ALL SELECT uuid, group_id, 'default' FROM node WHERE group_id = 'Brand#3'
        UNION ALL SELECT uuid, group_id, 'joined' FROM node WHERE group_id IN (SELECT 'Brand#' || n_regionkey FROM nation)""",
    ["node"],
)
check("c2_filter_label", "SELECT uuid, name, group_id FROM node WHERE label = 'ECONOMY'", ["node"])
check(
    "c3_get_facts",
    f"SELECT asked.uuid, fact, {iso('valid_at')} AS valid_at FROM asked LEFT JOIN edge USING (uuid)",
    ["edge0", "edge", "asked"],
)
check(
    "c3_get_fact",
    """SELECT uuid, fact, CAST(NULL AS VARCHAR) AS error FROM edge WHERE uuid = 'n:3>part_of' UNION ALL
        SELECT 'n:3>unknown', NULL, 'Error getting entity edge: edge n:3>unknown not found'""",
    ["edge0", "edge"],
)
check(
    "c4_episodes_before",
    f"SELECT uuid, group_id, {iso('reference_time')} AS reference_time FROM json_ep WHERE reference_time <= TIMESTAMP '{AS_OF}'",
    ["ev", "json_ep"],
)
check(
    "c5_check_membership",
    """SELECT key, known AS available, CASE WHEN known THEN 'Model available' ELSE 'Model ''' || key || ''' not found. Available models: ' || shown END AS message
        FROM (SELECT p_type AS key, true AS known FROM part UNION ALL SELECT p_brand, false FROM part),
        (SELECT string_agg(t, ', ' ORDER BY t) AS shown FROM (SELECT DISTINCT p_type AS t FROM part ORDER BY t LIMIT 5))""",
)

# --- D
_NEWEST = f"""SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reference_time DESC, uuid) AS position
    FROM json_ep WHERE reference_time <= TIMESTAMP '{AS_OF}'"""
check(
    "d1_get_episodes",
    f"SELECT uuid, group_id, {iso('reference_time')} AS reference_time FROM ({_NEWEST}) WHERE group_id = '7' AND position <= 10",
    ["ev", "json_ep"],
)
check(
    "d2_get_episodes_by_group",
    f"SELECT uuid, group_id, {iso('reference_time')} AS reference_time, position FROM ({_NEWEST}) WHERE position <= 10",
    ["ev", "json_ep"],
)
check(
    "d2_conversation_episodes",
    f"""SELECT uuid, group_id, source, content, {iso("reference_time")} AS reference_time FROM (SELECT *,
        row_number() OVER (PARTITION BY group_id ORDER BY reference_time DESC, uuid) AS position FROM msg_ep
        WHERE reference_time <= TIMESTAMP '{NOW}') WHERE position <= 5""",
    ["conv", "msg_ep"],
)
check(
    "d3_top_k",
    """SELECT * FROM (SELECT p_brand, CAST(p_partkey AS VARCHAR) AS uuid, p_retailprice,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, CAST(p_partkey AS VARCHAR)) AS rank FROM part) WHERE rank <= 5""",
)

# --- E
_DOC = bm25("hits", "documents", "CAST(doc_id AS VARCHAR)", "text", "bq", 10)
_BQ = {"bq": "SELECT item_id AS query_id, text FROM benchmark"}
_INDEX = {n: s for n, s in _DOC.items() if n in ("hits_doc", "hits_tf", "hits_df", "hits_st")}
check("e1_postings", "SELECT uuid AS doc_uuid, term, tf, dl FROM hits_tf", extra=_INDEX)
check("e1_terms", "SELECT term, df FROM hits_df", extra=_INDEX)
check("e1_stats", "SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM hits_st", extra=_INDEX)
check("e2_bm25_search", "SELECT query_id, uuid, round(score, 6) AS score, rank FROM hits", extra=_BQ | _DOC)
check("e1_segments", "SELECT term, df FROM hits_df", extra=_INDEX)
check("e1_segments_stats", "SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM hits_st", extra=_INDEX)
check("e2_bm25_search_stored", "SELECT query_id, uuid, round(score, 6) AS score, rank FROM hits", extra=_BQ | _DOC)
check(
    "g3_clear_index",
    f"""SELECT term, count(*) AS df FROM (SELECT DISTINCT uuid, unnest({words("name || ' ' || summary")}) AS term
        FROM ent WHERE group_id <> 'customer') GROUP BY term""",
    ["ent0", "ent"],
)
# e3_cosine_search_ann depends on Spark's random projections: no SQL, tested against the exact scores
check(
    "e3_cosine_search",
    "SELECT query_id, uuid, round(score, 6) AS score, rank FROM near",
    ["q"],
    {"emb": "SELECT CAST(vec_id AS VARCHAR) AS uuid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"}
    | cosine("near", "emb", "q", 10, "list_cosine_similarity(c.v, q.v) >= 0"),
)
check(
    "e3_cosine_search_ann",
    "SELECT query_id, uuid, round(score, 6) AS score, rank FROM near",
    ["q"],
    {"emb": "SELECT CAST(vec_id AS VARCHAR) AS uuid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"}
    | cosine("near", "emb", "q", 10, "list_cosine_similarity(c.v, q.v) >= 0"),
)
check("e3_cosine_search_ann_scores", "SELECT vec_id AS query_id, CAST(1 AS BIGINT) AS own_first, CAST(0 AS BIGINT) AS wrong FROM embeddings WHERE vec_id % 10 = 0")
check("e6_search_built_graph", "SELECT CAST(10 AS BIGINT) AS hits, CAST(10 AS BIGINT) AS same")
_NODE_TEXT = "name || ' ' || summary"
_NODES = hybrid("f", "node", _NODE_TEXT, "q", 10)
check("e4_rrf_fuse", "SELECT query_id, uuid, round(rrf, 6) AS rrf FROM f", ["node", "q"], _NODES)
_HOPS = ["h0", "h1", "h2", "h3"]
check(
    "e5_node_distance",
    "SELECT center, node, CAST(d AS BIGINT) AS distance FROM h3",
    ["edge0", "edge", "links", *_HOPS],
)
check(
    "e5_distances_to",
    """SELECT p.center, p.node, CAST(d AS BIGINT) AS distance FROM (SELECT 'n:' || ((c_nationkey + 1) % 25) AS center, 'c:' || c_custkey AS node FROM customer) p
        LEFT JOIN h3 ON h3.center = p.center AND h3.node = p.node""",
    ["edge0", "edge", "links", *_HOPS],
)
check(
    "e6_search_nodes_default_group",
    f"SELECT query_id, rank, round(rrf, 6) AS rrf, uuid, name, group_id FROM ({ranked('f', 'rrf DESC', 10)}) JOIN node USING (uuid)",
    ["node", "q"],
    hybrid("f", "node", _NODE_TEXT, "q", 10, "group_id = 'Brand#3'"),
)
check(
    "e6_search_nodes",
    f"""SELECT query_id, rank, round(rrf, 6) AS rrf, uuid, name, summary, group_id, {iso("created_at")} AS created_at, label AS labels
        FROM (SELECT * FROM ({ranked("f", "rrf DESC", 10)})) JOIN node USING (uuid)""",
    ["node", "q"],
    _NODES,
)
check(
    "e6_search_nodes_filtered",
    f"SELECT query_id, rank, round(rrf, 6) AS rrf, uuid, name, group_id FROM ({ranked('f', 'rrf DESC', 5)}) JOIN node USING (uuid)",
    ["node", "q"],
    hybrid("f", "node", _NODE_TEXT, "q", 5, "group_id IN ('Brand#2', 'Brand#17', 'Brand#4') AND label = 'ECONOMY'"),
)
check(
    "e6_search_nodes_centered",
    f"""SELECT query_id, rank, round(rrf, 6) AS rrf, CAST(d AS BIGINT) AS distance, uuid, name
        FROM ({ranked("placed", "d ASC NULLS LAST, rrf DESC", 10)}) JOIN ent USING (uuid)""",
    ["ent0", "ent", "edge0", "edge", "centered", "links", *_HOPS],
    hybrid("f", "ent", _NODE_TEXT, "centered", 10)
    | {"placed": "SELECT f.query_id, f.uuid, rrf, d FROM f JOIN centered c ON c.query_id = f.query_id LEFT JOIN h3 ON h3.center = c.center AND node = f.uuid"},
)
check(
    "e7_search_facts",
    f"SELECT query_id, rank, round(rrf, 6) AS rrf, uuid, fact, {iso('valid_at')} AS valid_at FROM ({ranked('f', 'rrf DESC', 10)}) JOIN edge USING (uuid)",
    ["edge0", "edge", "centered"],
    hybrid("f", "edge", "fact", "centered", 10),
)
check(
    "e7_search_facts_centered",
    f"""SELECT query_id, rank, round(rrf, 6) AS rrf, CAST(d AS BIGINT) AS distance, uuid, fact
        FROM ({ranked("placed", "d ASC NULLS LAST, rrf DESC", 5)}) JOIN edge USING (uuid)""",
    ["edge0", "edge", "centered", "links", *_HOPS],
    hybrid("f", "edge", "fact", "centered", 5)
    | {
        "placed": """SELECT f.query_id, f.uuid, rrf, least(a.d, b.d) AS d FROM f JOIN centered c ON c.query_id = f.query_id
            JOIN edge e ON e.uuid = f.uuid LEFT JOIN h3 a ON a.center = c.center AND a.node = src
            LEFT JOIN h3 b ON b.center = c.center AND b.node = dst"""
    },
)
check(
    "e8_passthrough_rerank",
    """SELECT p_brand AS query_id, p_partkey AS rank, p_name AS document,
        round(1.0::DOUBLE - (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 0.01::DOUBLE, 9) AS score FROM part""",
)

# --- F
check(
    "f1_split_turns",
    """SELECT uuid, CAST(n - 1 AS BIGINT) AS turn, role, string_agg(line, chr(10) ORDER BY i) AS text FROM (
        SELECT uuid, i, n, first_value(r) OVER (PARTITION BY uuid, n ORDER BY i) AS role,
            CASE WHEN opens THEN regexp_replace(l, '^(?i)(system|user|assistant):\\s*', '') ELSE l END AS line FROM (
            SELECT uuid, i, l, opens, CASE WHEN opens THEN lower(regexp_extract(l, '^(?i)(system|user|assistant):', 1)) ELSE 'user' END AS r,
                sum(CASE WHEN opens OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY i) AS n FROM (
                SELECT uuid, i, l, regexp_matches(l, '^(?i)(system|user|assistant):') AS opens FROM (
                    SELECT uuid, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM (
                        SELECT uuid, string_split(content, chr(10)) AS lines FROM msg_ep)))))
        GROUP BY uuid, n, role""",
    ["conv", "msg_ep"],
)
check(
    "f2_json_entities",
    "SELECT uuid AS episode_uuid, group_id, name AS label, name, '$' AS path, 'k=' || k AS attributes FROM json_ep",
    ["ev", "json_ep"],
)
_ORDER = "orders JOIN customer ON o_custkey = c_custkey"
check(
    "f2_json_entities_nested",
    f"""SELECT 'o-' || o_orderkey AS episode_uuid, o_orderstatus AS group_id, label, name, path, attributes FROM (
        SELECT o_orderkey, o_orderstatus, 'order' AS label, 'order' AS name, '$' AS path, '' AS attributes FROM {_ORDER}
        UNION ALL SELECT o_orderkey, o_orderstatus, 'customer', c_name, '$.customer', 'name="' || c_name || '"' FROM {_ORDER}
        UNION ALL SELECT o_orderkey, o_orderstatus, 'segment', c_mktsegment, '$.customer.segment', 'title="' || c_mktsegment || '"' FROM {_ORDER}
        UNION ALL SELECT o_orderkey, o_orderstatus, 'marks', o_orderstatus, '$.marks[0]', 'id="' || o_orderstatus || '",n=1' FROM {_ORDER}
        UNION ALL SELECT o_orderkey, o_orderstatus, 'marks', o_orderpriority, '$.marks[1]', 'id="' || o_orderpriority || '"' FROM {_ORDER})""",
)
check(
    "f2_json_entities_deep",
    """SELECT 'o-' || o_orderkey AS episode_uuid, CASE l WHEN 0 THEN 'order' ELSE 'in' || l END AS label, 'n' || l AS name,
        array_to_string(list_concat(['$'], list_transform(range(1, l + 1), lambda i: 'in' || i)), '.') AS path,
        CASE l WHEN 8 THEN 'key=' || o_orderkey || ',' ELSE '' END || 'name="n' || l || '"' AS attributes
        FROM orders, (SELECT unnest(range(0, 9)) AS l)""",
)
check(
    "f2_json_entities_deep40",
    """SELECT 'o-' || c_custkey AS episode_uuid, CASE l WHEN 0 THEN 'order' ELSE 'in' || l END AS label, 'n' || l AS name,
        array_to_string(list_concat(['$'], list_transform(range(1, l + 1), lambda i: 'in' || i)), '.') AS path,
        CASE l WHEN 40 THEN 'key=' || c_custkey || ',' ELSE '' END || 'name="n' || l || '"' AS attributes
        FROM customer, (SELECT unnest(range(0, 41)) AS l)""",
)
check(
    "f3_json_relations",
    f"""SELECT 'o-' || o_orderkey AS episode_uuid, source_name, target_name, name, source_name || ' ' || name || ' ' || target_name AS fact FROM (
        SELECT o_orderkey, 'order' AS source_name, c_name AS target_name, 'customer' AS name FROM {_ORDER}
        UNION ALL SELECT o_orderkey, c_name, c_mktsegment, 'segment' FROM {_ORDER}
        UNION ALL SELECT o_orderkey, 'order', o_orderstatus, 'marks' FROM {_ORDER}
        UNION ALL SELECT o_orderkey, 'order', o_orderpriority, 'marks' FROM {_ORDER})""",
)
check(
    "f4_extract_requirements",
    """SELECT uuid AS episode_uuid, name AS project_name, description, CAST(NULL AS VARCHAR) AS priority
        FROM text_ep, (VALUES ('fix '), ('Fix ')) p(prefix), LATERAL (SELECT prefix || k AS description) WHERE event_type = 'error'""",
    ["ev", "text_ep"],
)
_PREFERENCES = """SELECT uuid AS episode_uuid, 'other' AS category, 'item ' || k AS description, -1 AS polarity FROM text_ep WHERE event_type = 'view'
    UNION ALL SELECT uuid, 'other', 'item ' || k, 1 FROM text_ep, (VALUES (1), (2)) twice(i) WHERE event_type = 'purchase'
    UNION ALL SELECT uuid, 'other', 'basic', -1 FROM text_ep WHERE event_type = 'purchase'"""
check(
    "f5_extract_preferences",
    f"SELECT episode_uuid, category, description, CAST(polarity AS BIGINT) AS polarity FROM ({_PREFERENCES})",
    ["ev", "text_ep"],
)
check(
    "f6_extract_procedures",
    """SELECT uuid AS episode_uuid, 'First do ' || k || ', then do ship' AS description, CAST(NULL AS VARCHAR) AS trigger,
            CAST(step AS BIGINT) AS step, CASE step WHEN 1 THEN k ELSE 'ship' END AS action
        FROM text_ep, (VALUES (1), (2)) s(step) WHERE event_type = 'click'
        UNION ALL SELECT uuid, 'If signup occurs, then do welcome', 'signup', 1, 'welcome' FROM text_ep
        WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')""",
    ["ev", "text_ep"],
)
check(
    "f7_typed_extract",
    f"""SELECT episode_uuid, 'Preference' AS label, description AS name FROM ({_PREFERENCES})
        UNION ALL SELECT uuid, 'Requirement', prefix || k FROM text_ep, (VALUES ('fix '), ('Fix ')) p(prefix) WHERE event_type = 'error'
        UNION ALL SELECT uuid, 'Procedure', 'First do ' || k || ', then do ship' FROM text_ep WHERE event_type = 'click'
        UNION ALL SELECT uuid, 'Procedure', 'If signup occurs, then do welcome' FROM text_ep
        WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')""",
    ["ev", "text_ep"],
)
check(
    "f7_chat_statements",
    """SELECT 'chat-' || user_id AS episode_uuid, turn, label, name, replace(attributes, '@', 'chat') AS attributes
        FROM found WHERE label <> 'Preference' OR role = 'user'""",
    ["ev", "said", "found"],
)
check(
    "f7_line_statements",
    """SELECT 'note-' || user_id AS episode_uuid, CAST(NULL AS BIGINT) AS turn, label, name, replace(attributes, '@', 'note') AS attributes FROM found""",
    ["ev", "said", "found"],
)
check(
    "f8_validate_entities",
    """SELECT event_id, label, CASE WHEN missing <> '' THEN 'missing required fields: ' || missing END AS reason FROM (
        SELECT event_id, label, CASE label
            WHEN 'Requirement' THEN concat_ws(', ', 'project_name', CASE WHEN value < 5 THEN 'description' END)
            WHEN 'Preference' THEN concat_ws(', ', CASE WHEN value >= 20 THEN 'category' END, CASE WHEN value < 5 THEN 'description' END)
            WHEN 'Procedure' THEN CASE WHEN value < 5 THEN 'description' ELSE '' END ELSE '' END AS missing FROM (
            SELECT event_id, value, CASE event_type WHEN 'purchase' THEN 'Preference' WHEN 'error' THEN 'Requirement'
                WHEN 'click' THEN 'Procedure' ELSE 'Unregistered' END AS label FROM events))""",
)
check(
    "f9_parse_structured",
    """SELECT uuid, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'ok' WHEN 'view' THEN 'validation_error'
            WHEN 'click' THEN 'unstructured' ELSE 'json_error' END AS status,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'u' || user_id END AS p_name,
        CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS p_type,
        CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS p_confidence FROM struct_ep""",
    ["ev", "struct_ep"],
)
check(
    "f10_normalize_extracted",
    """SELECT 'ev-' || event_id AS uuid, CAST(p AS BIGINT) AS position, CAST(k AS BIGINT) AS entity_type_id, event_type AS name
        FROM ev, (VALUES (0), (1)) x(p) WHERE event_type IN ('view', 'click') OR (event_type = 'purchase' AND p = 0)""",
    ["ev"],
)
_SEEN = {
    "seen": f"""SELECT p_partkey, p_brand AS group_id, p_type AS label, lower(p_name) AS norm, p_size,
        CASE WHEN p_size >= 25 THEN '  ' || upper(p_name) ELSE p_name END AS name,
        {sid("p_brand", "p_type", "lower(p_name)")} AS uuid FROM part"""
}
check(
    "f11_resolve_entities",
    f"""SELECT uuid, arg_min(name, p_partkey) AS name, any_value(label) AS labels, any_value(group_id) AS group_id,
        {iso("min(make_timestamp(p_partkey * 60000000))")} AS created_at,
        any_value(label) || '=' || max(p_partkey) || ',size=' || arg_max(p_size, p_partkey) AS attributes FROM seen GROUP BY uuid""",
    extra=_SEEN,
)
check(
    "f11_stored_labels",
    "SELECT uuid, any_value(label) || ',Stored' AS labels, 'kept' AS summary, CAST(1 AS BIGINT) AS dim FROM seen GROUP BY uuid",
    extra=_SEEN,
)
# numbers counted from zero lead to zero by lowering one digit at a time
check(
    "f11_merge_similar",
    "SELECT uuid, left(uuid, 2) || '0' AS root FROM ent0 WHERE group_id IN ('customer', 'supplier')",
    ["ent0"],
)
check(
    "f12_build_mentions",
    """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS episode_uuid, uuid AS entity_uuid, group_id
        FROM lineitem JOIN seen ON l_partkey = p_partkey WHERE label <> 'PROMO'""",
    extra=_SEEN,
)
check(
    "f13_deep_merge",
    """SELECT key, array_to_string(path, '.') AS path, layer, value_json FROM kept k WHERE value_json <> '{}' OR NOT EXISTS (
        SELECT 1 FROM kept m WHERE m.key = k.key AND len(m.path) > len(k.path) AND m.path[1:len(k.path)] = k.path)""",
    extra={
        "layers": """SELECT o_custkey AS key, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS layer,
                CASE WHEN o_orderstatus = 'F' THEN ['last'] ELSE ['last', o_orderstatus] END AS path,
                CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN '{}' ELSE '"' || o_orderpriority || '"' END AS value_json FROM orders
            UNION ALL SELECT o_custkey, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'),
                ['seen', o_orderpriority], CAST(o_orderkey AS VARCHAR) FROM orders""",
        "kept": """SELECT * FROM layers p WHERE NOT EXISTS (SELECT 1 FROM layers q WHERE q.key = p.key AND q.layer > p.layer AND (
                q.path = p.path OR (len(q.path) < len(p.path) AND p.path[1:len(q.path)] = q.path AND q.value_json <> '{}')
                OR (len(q.path) > len(p.path) AND q.path[1:len(p.path)] = p.path)))""",
    },
)
check(
    "f14_node_summary",
    """SELECT ent.uuid, coalesce(left(string_agg(fact, ' ' ORDER BY valid_at, e.uuid), 300), '') AS summary, count(fact) AS degree
        FROM ent0 ent LEFT JOIN (SELECT src AS node, uuid, fact, valid_at FROM edge UNION ALL SELECT dst, uuid, fact, valid_at FROM edge) e
        ON node = ent.uuid GROUP BY ent.uuid""",
    ["ent0", "edge0", "edge"],
)
check(
    "f14_node_summary_full",
    """SELECT ent.uuid, coalesce(string_agg(fact, ' ' ORDER BY valid_at, e.uuid), '') AS summary, count(fact) AS degree
        FROM ent0 ent LEFT JOIN (SELECT src AS node, uuid, fact, valid_at FROM edge UNION ALL SELECT dst, uuid, fact, valid_at FROM edge) e
        ON node = ent.uuid GROUP BY ent.uuid""",
    ["ent0", "edge0", "edge"],
)
_SINGLE = "name IN ('view', 'purchase', 'signup')"


def closed(source: str) -> str:
    """Facts of `source` with validity, as the operator leaves them."""
    w = "(PARTITION BY group_id, source_node_uuid, name ORDER BY valid_at, uuid)"
    return f"""SELECT *, lead(valid_at) OVER {w} AS invalid_at, greatest(created_at, lead(created_at) OVER {w}) AS expired_at0, lead(uuid) OVER {w} AS follower
        FROM {source} WHERE {_SINGLE}
        UNION ALL SELECT *, NULL, NULL, NULL FROM (SELECT * FROM {source} WHERE NOT ({_SINGLE}) QUALIFY
            row_number() OVER (PARTITION BY group_id, source_node_uuid, name, target_node_uuid ORDER BY valid_at, created_at, uuid) = 1)"""


check(
    "f15_apply_facts",
    f"""SELECT uuid, group_id, source_node_uuid, target_node_uuid, name, {iso("valid_at")} AS valid_at, {iso("created_at")} AS created_at,
        {iso("invalid_at")} AS invalid_at, CASE WHEN follower IS NOT NULL THEN {iso("expired_at0")} END AS expired_at FROM c""",
    ["fact"],
    {"c": closed("fact")},
)
check("f15_apply_facts_hot", ORACLE["f15_apply_facts"])
check(
    "f15_provenance",
    """SELECT source_node_uuid, name, target_node_uuid, string_agg(uuid, ',' ORDER BY uuid) AS episodes FROM fact
        GROUP BY group_id, source_node_uuid, name, target_node_uuid""",
    ["fact"],
)
check(
    "f15_sightings",
    f"""SELECT uuid, uuid AS episode_uuid FROM fact WHERE {_SINGLE}
        UNION ALL SELECT first_value(uuid) OVER (PARTITION BY group_id, source_node_uuid, name, target_node_uuid
            ORDER BY valid_at, created_at, uuid), uuid FROM fact WHERE NOT ({_SINGLE})""",
    ["fact"],
)
_TRUE_AT = "valid_at <= TIMESTAMP '{t}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{t}')"
check(
    "f16_facts_as_of",
    f"SELECT uuid, source_node_uuid, name, target_node_uuid FROM c WHERE {_TRUE_AT.format(t=AS_OF)}",
    ["fact"],
    {"c": closed("fact")},
)
check(
    "f16_facts_as_known",
    f"SELECT uuid, source_node_uuid, name, target_node_uuid FROM c WHERE {_TRUE_AT.format(t=KNOWN)}",
    ["fact"],
    {"known": f"SELECT * FROM fact WHERE created_at <= TIMESTAMP '{AS_OF}'", "c": closed("known")},
)
check(
    "f16_facts_as_of_keys",
    """SELECT event_id, CAST(p.user_id AS VARCHAR) AS source_node_uuid, CASE WHEN live THEN f.uuid END AS fact_uuid,
        CASE WHEN live THEN f.target_node_uuid END AS target
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM fact WHERE name = 'view') f
        ON CAST(p.user_id AS VARCHAR) = f.source_node_uuid AND p.ts >= f.valid_at, LATERAL (SELECT p.ts < f.valid_at + INTERVAL 2 DAY AS live)""",
    ["fact"],
)
check("f16_facts_as_of_keys_hot", ORACLE["f16_facts_as_of_keys"])
check(
    "f17_embed_column",
    f"SELECT doc_id, CAST(64 AS BIGINT) AS dim, CASE WHEN len({words('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
)

# --- G
check(
    "g1_delete_facts",
    """SELECT uuid, 'kept' AS state FROM edge WHERE uuid NOT IN (SELECT uuid FROM asked)
        UNION ALL SELECT uuid, 'unknown' FROM asked WHERE uuid NOT IN (SELECT uuid FROM edge)""",
    ["edge0", "edge", "asked"],
)
check(
    "g2_delete_episodes",
    """SELECT uuid, state FROM json_ep, (VALUES ('episode'), ('mention')) s(state) WHERE uuid NOT IN (SELECT uuid FROM gone)
        UNION ALL SELECT uuid, 'unknown' FROM gone WHERE uuid NOT IN (SELECT uuid FROM json_ep)""",
    ["ev", "json_ep"],
    {"gone": "SELECT 'ev-' || (o_orderkey + 5000) AS uuid FROM orders"},
)
check(
    "g3_clear_graph",
    """SELECT 'some' AS form, 'entities' AS name, (SELECT count(*) FROM ent0 WHERE group_id <> 'customer') AS n
        UNION ALL SELECT 'some', 'facts', (SELECT count(*) FROM edge0 WHERE name <> 'based_in')
        UNION ALL SELECT 'some', 'episodes', (SELECT count(*) FROM events WHERE user_id <> 7)
        UNION ALL SELECT 'all', x, 0 FROM (VALUES ('entities'), ('facts'), ('episodes')) t(x)""",
    ["ent0", "edge0"],
)
check(
    "g4_graph_status",
    f"""SELECT e.group_id, episodes, entities, facts, active_facts, episodes AS mentions, newest_episode,
        'error' AS status, (2 * facts) || ' fact endpoints without entity' AS error FROM
        (SELECT group_id, count(*) AS episodes, count(DISTINCT name) AS entities, {iso("max(reference_time)")} AS newest_episode FROM json_ep GROUP BY group_id) e
        FULL JOIN (SELECT source_node_uuid AS group_id, count(*) AS facts, count(*) FILTER (invalid_at IS NULL) AS active_facts FROM c GROUP BY source_node_uuid) f
        ON e.group_id = f.group_id""",
    ["ev", "json_ep", "fact"],
    {"c": closed("fact")},
)

_OBJECTS = f"""SELECT o_orderkey, o_orderstatus AS g, 'order' AS label, 'order' AS name, CAST(NULL AS VARCHAR) AS parent FROM {_ORDER}
    UNION ALL SELECT o_orderkey, o_orderstatus, 'customer', c_name, 'order' FROM {_ORDER}
    UNION ALL SELECT o_orderkey, o_orderstatus, 'segment', c_mktsegment, c_name FROM {_ORDER}
    UNION ALL SELECT o_orderkey, o_orderstatus, 'marks', o_orderstatus, 'order' FROM {_ORDER}
    UNION ALL SELECT o_orderkey, o_orderstatus, 'marks', o_orderpriority, 'order' FROM {_ORDER}"""
check(
    "g4_graph_status_ok",
    f"""SELECT group_id, episodes, entities, facts, facts AS active_facts, mentions, newest_episode, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM
        (SELECT o_orderstatus AS group_id, count(*) AS episodes, {iso("max(o_orderdate)")} AS newest_episode FROM {_ORDER} GROUP BY 1)
        JOIN (SELECT g AS group_id, count(DISTINCT (label, lower(name))) AS entities, count(DISTINCT (o_orderkey, label, lower(name))) AS mentions,
            count(DISTINCT (lower(parent), label, lower(name))) FILTER (parent IS NOT NULL) AS facts FROM ({_OBJECTS}) GROUP BY 1) USING (group_id)""",
)

# --- H
check(
    "h1_messages_to_prompt",
    """SELECT conv_id, coalesce(string_agg(CASE coalesce(role, 'user') WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: '
        WHEN 'assistant' THEN 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn), '') AS prompt FROM conversations GROUP BY conv_id""",
)
check("h2_conversations_to_episodes", "SELECT conv_id, content, n_turns, 'message' AS source FROM conv", ["conv"])

# --- J
_REQUIREMENT = "SELECT DISTINCT uuid, group_id, name AS project, prefix || k AS d, reference_time FROM text_ep, (VALUES ('fix '), ('Fix ')) p(prefix) WHERE event_type = 'error'"
_TYPED = f"""SELECT uuid, group_id, 'Preference' AS label, 'item ' || k AS name, reference_time FROM text_ep WHERE event_type IN ('view', 'purchase')
    UNION ALL SELECT uuid, group_id, 'Preference', 'basic', reference_time FROM text_ep WHERE event_type = 'purchase'
    UNION ALL SELECT uuid, group_id, 'Requirement', d, reference_time FROM ({_REQUIREMENT})
    UNION ALL SELECT uuid, group_id, 'Project', project, reference_time FROM ({_REQUIREMENT})
    UNION ALL SELECT uuid, group_id, 'Procedure', 'First do ' || k || ', then do ship', reference_time FROM text_ep WHERE event_type = 'click'
    UNION ALL SELECT uuid, group_id, 'Procedure', 'If signup occurs, then do welcome', reference_time FROM text_ep
        WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')
    UNION ALL SELECT 'js-' || uuid, group_id, name, name, reference_time FROM json_ep"""
_IDS = {
    "cand": f"""SELECT *, {sid("group_id", "label", "lower(name)")} AS id FROM ({_TYPED})""",
    "f0": f"""SELECT group_id, reference_time, uuid AS episode, d || ' is a requirement of ' || project AS fact,
            {sid("group_id", "'Requirement'", "lower(d)")} AS s, {sid("group_id", "'Project'", "lower(project)")} AS o FROM ({_REQUIREMENT})""",
    "f": f"""SELECT {sid("group_id", "s", "'requirement_of'", "o", "epoch_us(reference_time)")} AS uuid, * FROM f0""",
}
# attribute values of a candidate, by key; the latest of each key stays
_VALUES = """SELECT uuid, group_id, 'Preference' AS label, 'item ' || k AS name, reference_time, unnest(['category', 'description', 'polarity']) AS key,
        unnest(['other', 'item ' || k, CASE event_type WHEN 'view' THEN '-1' ELSE '1' END]) AS val FROM text_ep WHERE event_type IN ('view', 'purchase')
    UNION ALL SELECT uuid, group_id, 'Preference', 'basic', reference_time, unnest(['category', 'description', 'polarity']), unnest(['other', 'basic', '-1'])
        FROM text_ep WHERE event_type = 'purchase'
    UNION ALL SELECT uuid, group_id, 'Requirement', prefix || k, reference_time, unnest(['description', 'project_name']), unnest([prefix || k, name])
        FROM text_ep, (VALUES ('fix '), ('Fix ')) p(prefix) WHERE event_type = 'error'
    UNION ALL SELECT uuid, group_id, 'Procedure', 'First do ' || k || ', then do ship', reference_time, 'description', 'First do ' || k || ', then do ship'
        FROM text_ep WHERE event_type = 'click'
    UNION ALL SELECT uuid, group_id, 'Procedure', 'If signup occurs, then do welcome', reference_time, unnest(['description', 'trigger']), unnest(['If signup occurs, then do welcome', 'signup'])
        FROM text_ep WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')
    UNION ALL SELECT 'js-' || uuid, group_id, name, name, reference_time, 'k', k FROM json_ep"""
check(
    "j1_stream_ingest",
    f"""SELECT 'episodes' AS kind, uuid, group_id, content AS body, CAST(NULL AS VARCHAR) AS attributes, {iso("reference_time")} AS since, CAST(NULL AS VARCHAR) AS until FROM text_ep
        UNION ALL SELECT 'episodes', 'js-' || uuid, group_id, content, NULL, {iso("reference_time")}, NULL FROM json_ep
        UNION ALL SELECT 'entities', id, any_value(group_id), arg_min(name, (reference_time, name)), coalesce(any_value(attributes), ''), {iso("min(reference_time)")}, NULL
            FROM cand LEFT JOIN attrs USING (id) GROUP BY id
        UNION ALL SELECT DISTINCT 'mentions', id, group_id, uuid, NULL, NULL, NULL FROM cand
        UNION ALL SELECT 'facts', uuid, group_id, fact, NULL, {iso("reference_time")}, {iso("nxt")} FROM (
            SELECT *, lead(reference_time) OVER (PARTITION BY group_id, s ORDER BY reference_time, uuid) AS nxt
            FROM (SELECT DISTINCT ON (uuid) * FROM f ORDER BY uuid, fact DESC))""",
    ["ev", "json_ep", "text_ep"],
    _IDS
    | {
        "vals": f"""SELECT {sid("group_id", "label", "lower(name)")} AS id, key, arg_max(val, (reference_time, val)) AS val FROM ({_VALUES}) GROUP BY 1, 2""",
        "attrs": "SELECT id, string_agg(key || '=' || val, ',' ORDER BY key) AS attributes FROM vals GROUP BY id",
    },
)
_KEPT = "CAST(regexp_extract({u}, '[0-9]+') AS BIGINT) % 2 = 1"
check(
    "j1_replaced_episode",
    f"""SELECT form, x.* FROM (VALUES ('whole'), ('later')) forms(form), (
        SELECT 'episodes' AS kind, uuid, CASE WHEN {_KEPT.format(u="uuid")} THEN content ELSE 'Nothing to say' END AS body FROM text_ep
        UNION ALL SELECT DISTINCT 'mentions', id, uuid FROM cand WHERE uuid NOT LIKE 'js-%' AND {_KEPT.format(u="uuid")}
        UNION ALL SELECT 'facts', uuid, fact FROM (SELECT *, row_number() OVER (PARTITION BY group_id, s, o ORDER BY reference_time, uuid, fact) AS n
            FROM f WHERE {_KEPT.format(u="episode")}) WHERE n = 1) x""",
    ["ev", "json_ep", "text_ep"],
    _IDS,
)
check(
    "j2_sequence_by_group",
    "SELECT uuid, group_id, row_number() OVER (PARTITION BY group_id ORDER BY reference_time, uuid) AS sequence FROM json_ep",
    ["ev", "json_ep"],
)
check(
    "j3_quarantine",
    "SELECT uuid, CASE WHEN event_type NOT IN ('purchase', 'signup', 'view') THEN 'content is not valid JSON' END AS error FROM struct_ep",
    ["ev", "struct_ep"],
)
check("j4_dedup_episodes", f"SELECT 'o-' || l_orderkey AS uuid, {iso('min(l_shipdate)')} AS reference_time FROM lineitem GROUP BY l_orderkey")
check("j4_dedup_stream", "SELECT uuid, group_id, content FROM json_ep", ["ev", "json_ep"])
_CACHE = dict(
    extra={
        "e": "SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
        "r": f"""SELECT event_id, user_id, ts, n, false AS hit, ts AS served FROM e WHERE n = 1 UNION ALL
            SELECT e.event_id, e.user_id, e.ts, e.n, epoch_us(e.ts) - epoch_us(r.served) < {CACHE_TTL}000000,
                CASE WHEN epoch_us(e.ts) - epoch_us(r.served) < {CACHE_TTL}000000 THEN r.served ELSE e.ts END
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1""",
    },
    recursive=True,
)
_CACHE_ROWS = f"SELECT event_id, user_id, {iso('ts')} AS ts, hit, {iso('served')} AS served_from FROM r"
check("j5_ttl_cache", _CACHE_ROWS, **_CACHE)
check("j5_ttl_cache_hot", _CACHE_ROWS, **_CACHE)
check("j5_ttl_cache_stream", _CACHE_ROWS, **_CACHE)
_BY_KEY = "PARTITION BY user_id, day"
_LIFE = {
    "ff": "SELECT *, min(CASE WHEN event = 'fail' THEN (ts, id) END) OVER (PARTITION BY user_id, day) AS fail1 FROM life",
    "ss": "SELECT *, min(CASE WHEN event = 'start' AND (fail1 IS NULL OR (ts, id) < fail1) THEN (ts, id) END) OVER (PARTITION BY user_id, day) AS start1 FROM ff",
    "cc": """SELECT *, min(CASE WHEN event = 'complete' AND (ts, id) > start1 AND (fail1 IS NULL OR (ts, id) < fail1) THEN (ts, id) END)
        OVER (PARTITION BY user_id, day) AS comp1 FROM ss""",
    "s": """SELECT user_id, day, CASE WHEN any_value(fail1) IS NOT NULL THEN 'failed' WHEN any_value(comp1) IS NOT NULL THEN 'completed'
            WHEN any_value(start1) IS NOT NULL THEN 'in_progress' ELSE 'not_started' END AS state,
        min(ts) FILTER ((ts, id) = start1) AS t0,
        coalesce(max(ts) FILTER (event = 'fail'), min(ts) FILTER ((ts, id) = comp1)) AS t1,
        arg_max(message, (ts, id)) FILTER (event = 'fail') AS error FROM cc GROUP BY user_id, day""",
}
_STATE = f"state, {iso('t0')} AS start_time, {iso('t1')} AS completion_time, error"
check(
    "j6_lifecycle",
    f"""SELECT user_id, day, {_STATE}, round((epoch_us(t1) - epoch_us(t0)) / 1e6, 6) AS duration_seconds,
        CASE WHEN state = 'in_progress' THEN round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(t0)) / 1e6, 6) END AS elapsed_seconds FROM s""",
    ["life"],
    _LIFE,
)
check(
    "j6_lifecycle_events",
    "SELECT id, event, NOT coalesce(CASE event WHEN 'fail' THEN true WHEN 'start' THEN (ts, id) = start1 ELSE (ts, id) = comp1 END, false) AS ignored FROM cc",
    ["life"],
    _LIFE,
)
check("j6_lifecycle_stream", f"SELECT user_id || '/' || day AS key, {_STATE} FROM s", ["life"], _LIFE)

# --- K
check(
    "k1_with_extractor",
    """SELECT uuid, CASE WHEN event_type = 'click' THEN 'Procedure' ELSE 'Preference' END AS label,
        CASE WHEN event_type <> 'click' THEN 'missing required fields: category, description' END AS reason FROM text_ep""",
    ["ev", "text_ep"],
)
check(
    "k2_with_embedder",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS x1, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS x2,
        CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS x3 FROM documents""",
)
check(
    "k3_with_reranker",
    "SELECT query_id, uuid, rank, round(1.0::DOUBLE - 0.01::DOUBLE * (rank - 1), 9) AS score FROM t",
    ["node", "q"],
    bm25("t", "node", "uuid", _NODE_TEXT, "q", 10),
)
