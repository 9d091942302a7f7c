"""SQL for DuckDB that gives the rows of the registered queries, written independently of them."""

from __future__ import annotations

# The order graphs as common table expressions: nd nodes, ed edges, sy both directions, tg targets, pt subgraphs by edge.
_KEY = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax"
_BASE = {
    "nd": f"SELECT l_orderkey AS graph_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}))::INTEGER AS node_id, p_type AS label, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey",
    "ed": "SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, 'seq' AS label, a.label AS lu, b.label AS lv FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 1 UNION ALL SELECT a.graph_id, a.node_id, b.node_id, 'flag', a.label, b.label FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 2 AND a.flag = b.flag",
    "sy": "SELECT graph_id, src, dst, label, lu, lv FROM ed UNION ALL SELECT graph_id, dst, src, label, lv, lu FROM ed",
    "tg": "SELECT o_orderkey AS graph_id, o_orderstatus AS target FROM orders",
    "sz": "SELECT graph_id, count(*) AS n_nodes FROM nd GROUP BY graph_id",
    "p0": "SELECT graph_id, (row_number() OVER (PARTITION BY graph_id ORDER BY src, dst, label))::INTEGER AS inode, src AS u, dst AS v, label AS elabel, lu, lv FROM ed",
    "p1": "SELECT *, md5(lu || '|' || elabel || ':' || lv) AS u1, md5(lv || '|' || elabel || ':' || lu) AS v1 FROM p0",
    "p2": "SELECT *, md5(u1 || '|' || elabel || ':' || v1) AS u2, md5(v1 || '|' || elabel || ':' || u1) AS v2 FROM p1",
    "p3": "SELECT *, md5(u2 || '|' || elabel || ':' || v2) AS hu, md5(v2 || '|' || elabel || ':' || u2) AS hv FROM p2",
    "pt": "SELECT *, md5(least(hu, hv) || ',' || greatest(hu, hv)) AS assoc_hash FROM p3",
    "mb": "SELECT graph_id, inode, u AS node_id, lu AS type, hu AS role FROM pt UNION ALL SELECT graph_id, inode, v, lv, hv FROM pt",
    "ct": "SELECT p.graph_id, p.inode, s.src AS inner_, s.dst AS outer_, s.label AS elabel, s.label || '|' || s.lu || '|' || s.lv AS ekey, s.lv AS outer_label FROM p0 p JOIN sy s ON p.graph_id = s.graph_id AND (s.src = p.u OR s.src = p.v) WHERE s.dst <> p.u AND s.dst <> p.v",
    "sg": "SELECT p.graph_id, p.inode, count(c.ekey) AS cut_size, coalesce(string_agg(c.ekey, ';' ORDER BY c.ekey), '') AS cut_key FROM p0 p LEFT JOIN ct c ON p.graph_id = c.graph_id AND p.inode = c.inode GROUP BY 1, 2",
    "mp": "SELECT c.graph_id, c.inode, md5(string_agg(c.ekey || '@' || m.role, ';' ORDER BY c.ekey || '@' || m.role)) AS map FROM ct c JOIN mb m ON c.graph_id = m.graph_id AND c.inode = m.inode AND c.inner_ = m.node_id GROUP BY 1, 2",
    "ix": "SELECT s.graph_id, s.inode, s.cut_key, p.assoc_hash, coalesce(m.map, md5('')) AS edge_map_sig FROM sg s JOIN pt p ON s.graph_id = p.graph_id AND s.inode = p.inode LEFT JOIN mp m ON s.graph_id = m.graph_id AND s.inode = m.inode",
    "sh": "SELECT a.graph_id, a.inode AS i, b.inode AS j, count(*) AS shared FROM mb a JOIN mb b ON a.graph_id = b.graph_id AND a.node_id = b.node_id AND a.inode <> b.inode GROUP BY 1, 2, 3",
    "cp": "SELECT p.graph_id, p.inode, p.assoc_hash AS img_type, count(s.j) AS deg FROM pt p LEFT JOIN sh s ON p.graph_id = s.graph_id AND p.inode = s.i GROUP BY 1, 2, 3",
    "pp": "SELECT a.graph_id, a.inode AS i, b.inode AS j, a.type, count(*) AS cnt FROM mb a JOIN mb b ON a.graph_id = b.graph_id AND a.node_id = b.node_id AND a.inode <> b.inode GROUP BY 1, 2, 3, 4",
    "w0": "SELECT graph_id, node_id, label AS h FROM nd",
    "w1": "SELECT n.graph_id, n.node_id, md5(n.h || '|' || coalesce(string_agg(s.label || ':' || m.h, ',' ORDER BY s.label || ':' || m.h), '')) AS h FROM w0 n LEFT JOIN sy s ON n.graph_id = s.graph_id AND n.node_id = s.src LEFT JOIN w0 m ON s.graph_id = m.graph_id AND s.dst = m.node_id GROUP BY n.graph_id, n.node_id, n.h",
    "w2": "SELECT n.graph_id, n.node_id, md5(n.h || '|' || coalesce(string_agg(s.label || ':' || m.h, ',' ORDER BY s.label || ':' || m.h), '')) AS h FROM w1 n LEFT JOIN sy s ON n.graph_id = s.graph_id AND n.node_id = s.src LEFT JOIN w1 m ON s.graph_id = m.graph_id AND s.dst = m.node_id GROUP BY n.graph_id, n.node_id, n.h",
    "w3": "SELECT n.graph_id, n.node_id, md5(n.h || '|' || coalesce(string_agg(s.label || ':' || m.h, ',' ORDER BY s.label || ':' || m.h), '')) AS h FROM w2 n LEFT JOIN sy s ON n.graph_id = s.graph_id AND n.node_id = s.src LEFT JOIN w2 m ON s.graph_id = m.graph_id AND s.dst = m.node_id GROUP BY n.graph_id, n.node_id, n.h",
    "gh": "SELECT graph_id, md5(string_agg(h, ',' ORDER BY h)) AS hash FROM w3 GROUP BY graph_id",
    "b1": "SELECT graph_id, node_id AS root, node_id, 0 AS dist FROM nd UNION SELECT graph_id, src, dst, 1 FROM sy",
    "b2": "SELECT graph_id, root, node_id, min(dist)::INTEGER AS dist FROM (SELECT * FROM b1 UNION SELECT b.graph_id, b.root, s.dst, 2 FROM b1 b JOIN sy s ON b.graph_id = s.graph_id AND b.node_id = s.src WHERE b.dist = 1) GROUP BY 1, 2, 3",
    "br": "SELECT DISTINCT graph_id, root, node_id FROM b1",
    "bs": "SELECT a.graph_id, a.root, s.src, s.dst, s.label FROM br a JOIN sy s ON a.graph_id = s.graph_id AND a.node_id = s.src JOIN br b ON a.graph_id = b.graph_id AND a.root = b.root AND b.node_id = s.dst",
    "r0": "SELECT b.graph_id, b.root, b.node_id, n.label AS h FROM br b JOIN nd n ON b.graph_id = n.graph_id AND b.node_id = n.node_id",
    "r1": "SELECT n.graph_id, n.root, n.node_id, md5(n.h || '|' || coalesce(string_agg(s.label || ':' || m.h, ',' ORDER BY s.label || ':' || m.h), '')) AS h FROM r0 n LEFT JOIN bs s ON n.graph_id = s.graph_id AND n.root = s.root AND n.node_id = s.src LEFT JOIN r0 m ON s.graph_id = m.graph_id AND s.root = m.root AND s.dst = m.node_id GROUP BY n.graph_id, n.root, n.node_id, n.h",
    "r2": "SELECT n.graph_id, n.root, n.node_id, md5(n.h || '|' || coalesce(string_agg(s.label || ':' || m.h, ',' ORDER BY s.label || ':' || m.h), '')) AS h FROM r1 n LEFT JOIN bs s ON n.graph_id = s.graph_id AND n.root = s.root AND n.node_id = s.src LEFT JOIN r1 m ON s.graph_id = m.graph_id AND s.root = m.root AND s.dst = m.node_id GROUP BY n.graph_id, n.root, n.node_id, n.h",
    "rh": "SELECT graph_id, root AS node_id, md5(string_agg(h, ',' ORDER BY h)) AS hash FROM r2 GROUP BY 1, 2",
    "mi": "SELECT s.graph_id, a.x::INTEGER AS src, b.y::INTEGER AS dst FROM sz s, range(1, s.n_nodes + 1) a(x), range(1, s.n_nodes + 1) b(y) WHERE a.x < b.y AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.graph_id = s.graph_id AND e.src = a.x AND e.dst = b.y)",
    "dg": "SELECT graph_id, node_id, count(*) AS deg FROM (SELECT graph_id, src AS node_id FROM ed UNION ALL SELECT graph_id, dst FROM ed) GROUP BY 1, 2",
    "po": "SELECT n.graph_id, n.node_id, n.label, (row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(d.deg, 0) DESC, n.node_id) - 1) AS pos, count(*) OVER (PARTITION BY n.graph_id) AS size FROM nd n LEFT JOIN dg d USING (graph_id, node_id)",
    "pr": "SELECT a.graph_id, CASE WHEN b.pos >= a.pos // 4 * 4 THEN 'within' ELSE 'between' END AS kind, least(floor((a.pos // 4 * 4) / a.size::DOUBLE * 4), 3)::INTEGER AS bin, least(a.label, b.label) AS lu, greatest(a.label, b.label) AS lv, EXISTS (SELECT 1 FROM ed e WHERE e.graph_id = a.graph_id AND e.src = least(a.node_id, b.node_id) AND e.dst = greatest(a.node_id, b.node_id)) AS has_edge FROM po a JOIN po b ON a.graph_id = b.graph_id AND b.pos < a.pos",
    "em": "SELECT label, n, round(n / sum(n) OVER (), 6)::DOUBLE AS p FROM (SELECT label, (2 * count(*))::BIGINT AS n FROM ed GROUP BY label UNION ALL SELECT 'none', (SELECT sum(n_nodes * (n_nodes - 1)) FROM sz)::BIGINT - 2 * (SELECT count(*) FROM ed))",
    "pv": "SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings",
    "kn": "SELECT i, j, rank, round(d, 6) AS d FROM (SELECT i, j, d, (row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j))::INTEGER AS rank FROM (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM pv a JOIN pv b ON a.id <> b.id)) WHERE rank <= 5",
    "ms": "SELECT c_nationkey AS model, avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(length(c_name) + c_custkey % 7)::DOUBLE AS m2, stddev_pop(c_custkey % 7) AS s2 FROM customer GROUP BY 1",
    "ev": "SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events",
    "nl": "SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, 1.0::DOUBLE / count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2",
    "lp": "SELECT (o_orderpriority = '1-URGENT')::INTEGER AS y, (o_totalprice > 200000)::INTEGER AS z FROM orders",
    "sk": "SELECT graph_id, md5(string_agg(lpad(src::VARCHAR, 4, '0') || '-' || lpad(dst::VARCHAR, 4, '0') || '-' || label, ';' ORDER BY lpad(src::VARCHAR, 4, '0') || '-' || lpad(dst::VARCHAR, 4, '0') || '-' || label)) AS state_key FROM ed GROUP BY 1",
}
_BASE |= {
    "vk": "SELECT graph_id, inode, count(*) AS k, string_agg(outer_label, ';' ORDER BY outer_label) AS cut_key FROM (SELECT DISTINCT graph_id, inode, outer_, outer_label FROM ct) GROUP BY 1, 2",
    "cb": """SELECT graph_id, 1 AS k, (node_id - 1)::BIGINT AS rank, node_id::VARCHAR AS nodes, label AS cut_key FROM nd UNION ALL
        SELECT a.graph_id, 2, a.node_id - 1 + (b.node_id - 1) * (b.node_id - 2) // 2, a.node_id || ',' || b.node_id, array_to_string(list_sort([a.label, b.label]), ';') FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND a.node_id < b.node_id UNION ALL
        SELECT a.graph_id, 3, a.node_id - 1 + (b.node_id - 1) * (b.node_id - 2) // 2 + (c.node_id - 1) * (c.node_id - 2) * (c.node_id - 3) // 6, a.node_id || ',' || b.node_id || ',' || c.node_id, array_to_string(list_sort([a.label, b.label, c.label]), ';')
        FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND a.node_id < b.node_id JOIN nd c ON a.graph_id = c.graph_id AND b.node_id < c.node_id""",
    "ch3": "SELECT graph_id, n_nodes AS n, [n_nodes, n_nodes * (n_nodes - 1) // 2, n_nodes * (n_nodes - 1) * (n_nodes - 2) // 6] AS c FROM sz",
}
_NEEDS = {
    "vk": "ct", "cb": "nd", "ch3": "sz",
    "ed": "nd", "sy": "ed", "sz": "nd", "p0": "ed", "p1": "p0", "p2": "p1", "p3": "p2", "pt": "p3", "mb": "pt", "ct": "p0 sy", "sg": "p0 ct", "mp": "ct mb", "ix": "sg pt mp", "sh": "mb", "cp": "pt sh", "pp": "mb",
    "w0": "nd", "w1": "w0 sy", "w2": "w1 sy", "w3": "w2 sy", "gh": "w3", "b1": "nd sy", "b2": "b1 sy", "br": "b1", "bs": "br sy", "r0": "br nd", "r1": "r0 bs", "r2": "r1 bs", "rh": "r2", "mi": "sz ed", "dg": "ed", "po": "nd dg",
    "pr": "po ed", "em": "ed sz", "kn": "pv", "sk": "ed",
}


def _bits(text: str, n: int) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {1 << n})"


def _uniform(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)"


def _sql(uses: str, body: str) -> str:
    """body, after those common tables that uses names and all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for name in uses.split():
        add(name)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({_BASE[n]})" for n in order) + ("" if body.startswith(",") else " ") if order else "") + body


_PAIRS = "SELECT cut_key, n_source::BIGINT AS n_source, n_donor::BIGINT AS n_donor, (n_source * n_donor - same)::BIGINT AS n_pairs FROM (SELECT cut_key, sum(s) AS n_source, sum(d) AS n_donor, sum(s * d) AS same FROM (SELECT cut_key, assoc_hash, count(*) FILTER (graph_id % 2 = 0) AS s, count(*) FILTER (graph_id % 2 = 1) AS d FROM ix GROUP BY 1, 2) GROUP BY 1) WHERE n_source > 0 AND n_donor > 0"
_ORDER_OF_REMOVAL = ", ro AS (SELECT graph_id, src, dst, label, row_number() OVER (PARTITION BY graph_id ORDER BY md5('12|' || graph_id || '|' || src || '|' || dst || '|' || label), src, dst, label) AS rank FROM ed)"
_FIT = """WITH p AS (SELECT l_returnflag AS key, l_linenumber::BIGINT AS n, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2), g AS (SELECT p.*, 0.3::DOUBLE + i.range * 0.01::DOUBLE AS alpha FROM p, range(0, 171) i),
        s AS (SELECT key, alpha, count(*) AS k, sum(pow(n, -alpha)) AS sx, sum(y) AS sy, sum(pow(n, -2 * alpha)) AS sxx, sum(pow(n, -alpha) * y) AS sxy, sum(y * y) AS syy FROM g GROUP BY 1, 2),
        f AS (SELECT *, (k * sxy - sx * sy) / (k * sxx - sx * sx) AS b FROM s), h AS (SELECT *, (sy - b * sx) / k AS a FROM f), e AS (SELECT *, syy - a * sy - b * sxy AS sse FROM h)
        SELECT DISTINCT ON (key) key, round(alpha, 2) AS alpha, round(a, 4) AS a, round(b, 4) AS b FROM e ORDER BY key, round(sse, 9), alpha"""
_CHOICE = """, dn AS (SELECT cut_key, assoc_hash, graph_id AS donor_graph, inode AS donor_inode FROM ix WHERE graph_id % 2 = 1 AND cut_key <> ''),
    cd AS (SELECT DISTINCT ON (s.graph_id) s.graph_id, s.inode, d.donor_graph, d.donor_inode FROM ix s JOIN dn d ON s.cut_key = d.cut_key AND s.assoc_hash <> d.assoc_hash WHERE s.graph_id % 2 = 0 ORDER BY s.graph_id, s.inode, d.donor_graph, d.donor_inode),
    ch AS (SELECT cd.*, z.n_nodes, z.n_edges FROM cd JOIN (SELECT graph_id, max(greatest(src, dst))::BIGINT AS n_nodes, count(*) AS n_edges FROM ed GROUP BY 1) z USING (graph_id))"""
_STATS = "round((count(*) FILTER (has_edge) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE), 6) AS p"
_SPLIT = _bits("graph_id::VARCHAR", 32) + " % 10"
_FLAG = "RECURSIVE nd AS MATERIALIZED (" + _BASE["nd"] + "), fl AS MATERIALIZED (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 2 AND a.flag = b.flag), fs AS (SELECT * FROM fl UNION ALL SELECT graph_id, dst, src FROM fl), rc AS (SELECT graph_id, node_id, node_id AS seen FROM nd UNION SELECT r.graph_id, r.node_id, f.dst FROM rc r JOIN fs f ON r.graph_id = f.graph_id AND r.seen = f.src), cc AS (SELECT graph_id, node_id, min(seen) AS component FROM rc GROUP BY 1, 2)"


def _disjoint_paths(source: int, target: int, n_paths: int, nodes: int) -> str:
    """SQL for the shortest paths that share no edge among at most so many nodes: rounds of relaxation, then the way back, path by path."""
    ways = f"nl AS MATERIALIZED ({_BASE['nl']}), w1 AS MATERIALIZED (SELECT src, dst, w FROM nl UNION ALL SELECT dst, src, w FROM nl)"
    for p in range(1, n_paths + 1):
        ways += f", d{p}_0 AS (SELECT {source}::BIGINT AS id, 0.0::DOUBLE AS dist), " + ", ".join(f"d{p}_{k} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{p}_{k - 1} UNION ALL SELECT w.dst, d.dist + w.w FROM d{p}_{k - 1} d JOIN w{p} w ON d.id = w.src) GROUP BY 1)" for k in range(1, nodes))
        ways += f", b{p} AS MATERIALIZED (SELECT DISTINCT ON (w.dst) w.dst AS node, w.src AS id FROM w{p} w JOIN d{p}_{nodes - 1} d ON w.src = d.id WHERE w.dst <> {source} ORDER BY w.dst, round(d.dist + w.w, 12), w.src)"
        ways += f", t{p} AS (SELECT id, 0 AS back FROM d{p}_{nodes - 1} WHERE id = {target} UNION ALL SELECT b.id, t.back + 1 FROM t{p} t JOIN b{p} b ON b.node = t.id), x{p} AS MATERIALIZED (SELECT {p} AS path, ((SELECT max(back) FROM t{p}) - back)::INTEGER AS pos, id FROM t{p})"
        ways += f", w{p + 1} AS MATERIALIZED (SELECT * FROM w{p} w WHERE NOT EXISTS (SELECT 1 FROM x{p} a JOIN x{p} b ON b.pos = a.pos + 1 WHERE (a.id = w.src AND b.id = w.dst) OR (a.id = w.dst AND b.id = w.src)))"
    return "WITH RECURSIVE " + ways + " " + " UNION ALL ".join(f"SELECT * FROM x{p}" for p in range(1, n_paths + 1))


ORACLE_SQL: dict[str, str] = {
    "k_cut_edges": _sql("ct", "SELECT graph_id, inode, inner_ AS \"inner\", outer_ AS \"outer\", elabel, ekey FROM ct"),
    "k_edge_key": _sql("sy", "SELECT label AS key_label, label || '|' || lu AS key_inner, label || '|' || lv AS key_outer, label || '|' || lu || '|' || lv AS key_both, count(*) AS n FROM sy GROUP BY label, lu, lv"),
    "k_cut_signature": _sql("sg", "SELECT * FROM sg"),
    "k_cut_index": _sql("ix", "SELECT * FROM ix"),
    "k_cut_dedup": _sql("ix", "SELECT cut_key, assoc_hash, edge_map_sig, count(*) AS freq FROM ix GROUP BY 1, 2, 3"),
    "k_cut_merge": _sql("ix", "SELECT cut_key, assoc_hash, edge_map_sig, count(*) AS freq FROM ix GROUP BY 1, 2, 3"),
    "k_cut_size_hist": _sql("sg", "SELECT cut_size, count(*) AS freq FROM sg GROUP BY 1"),
    "k_ball": _sql("b2", "SELECT * FROM b2"),
    "k_radius_hash": _sql("rh", "SELECT * FROM rh"),
    "k_anchor_type": _sql("rh", f"SELECT graph_id, node_id, {_bits('hash', 10)} AS bucket FROM rh"),
    "k_node_keys": _sql("rh", "SELECT hash, count(*) AS n FROM rh GROUP BY 1"),
    "k_virtual_cut": _sql("ct", "SELECT graph_id, inode, count(*) AS cut_size, string_agg(outer_label, ';' ORDER BY outer_label) AS cut_key FROM (SELECT DISTINCT graph_id, inode, outer_, outer_label FROM ct) GROUP BY 1, 2"),
    "k_virtual_candidates": _sql("ct nd", "SELECT cut_key, n_sets, n_entries FROM (SELECT least(a.label, b.label) || ';' || greatest(a.label, b.label) AS cut_key, count(*) AS n_sets FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND a.node_id < b.node_id GROUP BY 1) JOIN (SELECT cut_key, count(*) AS n_entries FROM (SELECT string_agg(outer_label, ';' ORDER BY outer_label) AS cut_key, count(*) AS k FROM (SELECT DISTINCT graph_id, inode, outer_, outer_label FROM ct) GROUP BY graph_id, inode) WHERE k = 2 GROUP BY 1) USING (cut_key)"),
    "k_overlap_sig": _sql("sh pt", "SELECT signature, count(*) AS n FROM (SELECT md5(string_agg(p.assoc_hash || ':' || s.shared, ';' ORDER BY p.assoc_hash || ':' || s.shared)) AS signature FROM sh s JOIN pt p ON s.graph_id = p.graph_id AND s.j = p.inode GROUP BY s.graph_id, s.i) GROUP BY 1"),
    "j_rewrite_pairs": _sql("ix", _PAIRS),
    "j_bucket": _sql("cp", "SELECT img_type, deg, count(*) AS n_components FROM cp GROUP BY 1, 2"),
    "j_inverted_semi": _sql("pp", "SELECT type, mult::INTEGER AS mult, count(*) AS n_candidates FROM (SELECT DISTINCT graph_id, i, type, m.mult FROM pp, range(1, cnt + 1) m(mult)) GROUP BY 1, 2"),
    "j_multiset_contains": _sql("pp", "SELECT graph_id, i, j FROM pp WHERE type = 'PROMO' AND cnt >= 1"),
    "j_transitions": _sql("pp pt", "SELECT prev, role, next, n, rank FROM (SELECT a.assoc_hash AS prev, p.type AS role, b.assoc_hash AS next, count(*) AS n, (row_number() OVER (PARTITION BY a.assoc_hash, p.type ORDER BY count(*) DESC, b.assoc_hash))::INTEGER AS rank FROM pp p JOIN pt a ON p.graph_id = a.graph_id AND p.i = a.inode JOIN pt b ON p.graph_id = b.graph_id AND p.j = b.inode GROUP BY 1, 2, 3) WHERE rank <= 256"),
    "j_anchor_filter": _sql("ix", "SELECT cut_key, count(*) AS n FROM ix WHERE graph_id % 2 = 0 AND cut_key IN (SELECT cut_key FROM ix WHERE graph_id % 2 = 1) GROUP BY 1"),
    "j_anchor_mapping": _sql(
        "ct",
        f""", pl AS (SELECT graph_id, node_id, label, row_number() OVER (PARTITION BY graph_id, label ORDER BY md5('0|' || graph_id || '|' || node_id), node_id) - 1 AS place, count(*) OVER (PARTITION BY graph_id, label) AS n FROM nd WHERE graph_id % 2 = 1),
        an AS (SELECT graph_id, inode, inner_, outer_, outer_label, row_number() OVER (PARTITION BY graph_id, inode, outer_label ORDER BY inner_, outer_) - 1 AS k, count(*) OVER (PARTITION BY graph_id, inode) AS asked,
                      {_bits("'0|' || graph_id || '|' || inode || '|' || outer_label", 31)} AS shift FROM ct WHERE graph_id % 2 = 0),
        ma AS (SELECT a.*, p.node_id AS mapped FROM an a JOIN pl p ON p.graph_id = a.graph_id + 1 AND p.label = a.outer_label AND a.k < p.n AND p.place = (a.k + a.shift) % p.n),
        fu AS (SELECT * FROM ma QUALIFY count(*) OVER (PARTITION BY graph_id, inode) = asked),
        co AS (SELECT f.graph_id, f.inode, count(DISTINCT e.src || '|' || e.dst || '|' || e.label) AS n_covered FROM fu f JOIN ed e ON e.graph_id = f.graph_id + 1 AND (e.src = f.mapped OR e.dst = f.mapped) GROUP BY 1, 2)
        SELECT f.graph_id, f.inode, f.inner_ AS "inner", f.outer_ AS "outer", f.mapped, c.n_covered FROM fu f JOIN co c USING (graph_id, inode)""",
    ),
    "j_image_edge_anti": _sql("sh", "SELECT graph_id, count(*) AS n_violations FROM sh WHERE i < j AND shared <> 1 GROUP BY 1"),
    "j_knn": _sql("kn", "SELECT * FROM kn"),
    "j_mutual_knn": _sql("kn", "SELECT a.i, a.j, a.d FROM kn a JOIN kn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j"),
    "j_pairwise": _sql("pv", "SELECT label, count(*) AS n, round(avg(d), 6) AS mean_d, round(max(d), 6) AS max_d FROM (SELECT a.label, list_distance(a.x, b.x) AS d FROM pv a JOIN pv b ON a.label = b.label AND a.id < b.id) GROUP BY 1"),
    "a_group_target": _sql("tg", "SELECT target, count(*) AS n, min(graph_id) AS first_graph_id FROM tg GROUP BY 1"),
    "a_image_groups": _sql("gh", "SELECT hash, count(*) AS n, min(graph_id) AS first_graph_id, count(*) >= 5 AS enough FROM gh GROUP BY 1"),
    "a_allocate": _sql("tg", "SELECT key, (base + (rank <= left_)::INTEGER)::BIGINT AS n FROM (SELECT *, row_number() OVER (ORDER BY round(share - base, 9) DESC, key) AS rank, 1000 - sum(base) OVER () AS left_ FROM (SELECT target AS key, 1000.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share, floor(1000.0::DOUBLE * count(*) / sum(count(*)) OVER ())::BIGINT AS base FROM tg GROUP BY 1))"),
    "a_edge_stats": _sql("pr", " UNION ALL ".join(f"SELECT {', '.join(c if c in g else f'NULL::{t} AS {c}' for c, t in (('kind', 'VARCHAR'), ('bin', 'INTEGER'), ('lu', 'VARCHAR'), ('lv', 'VARCHAR')))}, {level}::BIGINT AS level, count(*) FILTER (has_edge) AS edges, count(*) AS total, {_STATS} FROM pr GROUP BY {', '.join(g)}" for level, g in ((0, ("kind", "bin", "lu", "lv")), (4, ("kind", "lu", "lv")), (3, ("kind", "bin")), (7, ("kind",)))).replace("kind, bin, lu, lv, 0", "kind, bin AS ratio_bin, lu, lv, 0").replace("NULL::INTEGER AS bin", "NULL::INTEGER AS ratio_bin")),
    "a_label_hist": _sql("nd tg", "SELECT target, label, n, round(n / sum(n) OVER (PARTITION BY target), 6)::DOUBLE AS p FROM (SELECT target, label, count(*) AS n FROM nd JOIN tg USING (graph_id) GROUP BY 1, 2)"),
    "a_size_hist": _sql("sz tg", "SELECT target, n_nodes, count(*) AS n FROM sz JOIN tg USING (graph_id) GROUP BY 1, 2"),
    "a_density": _sql("sz tg ed", "SELECT target, count(*) AS n_graphs, round(avg(2.0::DOUBLE * coalesce(m, 0) / (n_nodes * (n_nodes - 1))), 6) AS density FROM sz LEFT JOIN (SELECT graph_id, count(*) AS m FROM ed GROUP BY 1) USING (graph_id) JOIN tg USING (graph_id) WHERE n_nodes > 1 GROUP BY 1"),
    "a_edge_marginals": _sql("em", "SELECT * FROM em"),
    "a_quantile_stats": "SELECT o_orderpriority, count(o_totalprice) AS n, round((quantile_cont(o_totalprice, 0.25) + quantile_cont(o_totalprice, 0.5) + quantile_cont(o_totalprice, 0.75)) / 3, 6) AS mean, round(CASE WHEN count(o_totalprice) > 1 THEN (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 1.34898::DOUBLE ELSE 0 END, 6) AS std FROM orders GROUP BY 1",
    "a_trimmed": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS b FROM orders) WHERE a > 1 AND b > 1 GROUP BY 1",
    "a_equalize": _sql("tg", "SELECT target, graph_id, c.copy::INTEGER AS copy FROM (SELECT target, graph_id, row_number() OVER (PARTITION BY target ORDER BY md5('7|' || graph_id), graph_id) AS pos, count(*) OVER (PARTITION BY target) AS size, (SELECT max(n) FROM (SELECT count(*) AS n FROM tg GROUP BY target)) AS most FROM tg), range(1, greatest(ceil((most - pos + 1) / size::DOUBLE)::BIGINT, 1) + 1) c(copy)"),
    "a_err_prop": _sql("ms", "SELECT model AS key, round(sqrt((s1 / m2) ** 2 + (m1 * s2 / (m2 * m2)) ** 2), 6) AS ratio, round(sqrt((m1 * s2) ** 2 + (m2 * s1) ** 2 + (s1 * s2) ** 2), 6) AS product, round(sqrt(s1 ** 2 + s2 ** 2), 6) AS total, round(sqrt(s1 ** 2 + s2 ** 2), 6) AS difference, round(sqrt(s1 ** 2 + s2 ** 2) / 2, 6) AS average FROM ms"),
    "a_quality_scores": "SELECT key, round(q, 6) AS quality, round(u, 6) AS utility, round(least(greatest((q + u) / 2 * a, 0), 1), 6) AS exchangeability, round(least(greatest((q + u) / 2 / (1 + a), 0), 1), 6) AS creativity FROM (SELECT key, CASE WHEN real_ = 0 THEN 0 ELSE least(greatest(gen / real_, 0), 1) END AS q, least(greatest(greatest(both_ - real_, 1e-6::DOUBLE) / greatest(gen - real_, 1e-6::DOUBLE), 0), 1) AS u, (1 - accuracy + similarity) / 2 AS a FROM (SELECT c_custkey AS key, (c_custkey % 97)::DOUBLE / 97 AS real_, (c_custkey % 89)::DOUBLE / 89 AS gen, (c_custkey % 83)::DOUBLE / 83 AS both_, (c_custkey % 79)::DOUBLE / 79 AS accuracy, (c_custkey % 73)::DOUBLE / 73 AS similarity FROM customer))",
    "a_degree_penalty": "WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), d AS (SELECT quantile_cont(deg, 0.75) AS p75 FROM (SELECT v, count(*) AS deg FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)), m AS (SELECT quantile_cont(w, 0.5) AS median_w FROM e) SELECT p75, round(0.25::DOUBLE / p75, 6) AS multiplicative, round(median_w, 6) AS median_w, round(0.25::DOUBLE * median_w / p75, 6) AS additive FROM d, m",
    "a_beta_posterior": "SELECT key, round(a, 6) AS alpha, round(b, 6) AS beta, round(a / (a + b), 6) AS mean FROM (SELECT user_id AS key, 1 + sum(r) AS a, 1 + sum(1 - r) AS b FROM (SELECT user_id, (event_id % 101)::DOUBLE / 100 AS r FROM events) GROUP BY 1)",
    "a_learned_weights": "SELECT user_id AS key, round(avg((event_type <> 'error')::INTEGER), 6) AS accept, round(1.0::DOUBLE / (1 + count(*)), 6) AS usage, round(1.0::DOUBLE / (1 + count(*) FILTER (event_type = 'error')), 6) AS failure FROM events GROUP BY 1",
    "a_edge_prob": _sql("pr", ", s0 AS (SELECT kind, bin, lu, lv, " + _STATS + " FROM pr GROUP BY 1, 2, 3, 4), s4 AS (SELECT kind, lu, lv, " + _STATS + " FROM pr GROUP BY 1, 2, 3), s3 AS (SELECT kind, bin, " + _STATS + " FROM pr GROUP BY 1, 2), s7 AS (SELECT kind, " + _STATS + " FROM pr GROUP BY 1), q AS (SELECT DISTINCT k.kind, b.bin::INTEGER AS bin, x.p_type AS lu, y.p_type AS lv FROM (VALUES ('within'), ('between')) k(kind), range(4) b(bin), part x, (SELECT DISTINCT p_type FROM part) y WHERE x.p_type <= y.p_type) SELECT q.kind, q.bin AS ratio_bin, q.lu, q.lv, coalesce(s0.p, s4.p, s3.p, s7.p) AS p FROM q LEFT JOIN s0 ON q.kind = s0.kind AND q.bin = s0.bin AND q.lu = s0.lu AND q.lv = s0.lv LEFT JOIN s4 ON q.kind = s4.kind AND q.lu = s4.lu AND q.lv = s4.lv LEFT JOIN s3 ON q.kind = s3.kind AND q.bin = s3.bin LEFT JOIN s7 ON q.kind = s7.kind"),
    "a_similarity_entropy": _sql("kn", ", f AS (SELECT k.i, avg((p.label < 5)::INTEGER::DOUBLE) AS p FROM kn k JOIN pv p ON p.id = k.j GROUP BY 1), g AS (SELECT avg((label < 5)::INTEGER::DOUBLE) AS p FROM pv), r AS (SELECT count(*) AS n, avg(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END) AS e FROM f) SELECT n, round(e, 6) AS entropy, round(e / (-p * log2(p) - (1 - p) * log2(1 - p)), 6) AS score FROM r, g"),
    "p_closest": _sql("pv", ", u AS (SELECT label, id, unnest(x) AS v, unnest(range(len(x))) AS dim FROM pv), m AS (SELECT label, dim, avg(v) AS m FROM u GROUP BY 1, 2), d AS (SELECT u.label, id, sqrt(sum((v - m) ** 2)) AS d FROM u JOIN m ON u.label = m.label AND u.dim = m.dim GROUP BY 1, 2) SELECT label, first(id ORDER BY round(d, 9), id) AS id, round(min(d), 6) AS d FROM d GROUP BY 1"),
    "g_connect": f"WITH {_FLAG}, z AS (SELECT DISTINCT graph_id, component FROM cc), y AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY component) AS r FROM z) SELECT a.graph_id, a.component AS src, b.component AS dst FROM y a JOIN y b ON a.graph_id = b.graph_id AND a.r = 1 AND b.r = 2",
    "s_pairs": _sql("tg", "SELECT target, pair, a, b FROM (SELECT target, ((pos + 1) // 2)::BIGINT AS pair, min_by(graph_id, pos) AS a, max_by(graph_id, pos) AS b, count(*) AS n FROM (SELECT target, graph_id, row_number() OVER (PARTITION BY target ORDER BY md5('1|' || graph_id), graph_id) AS pos FROM tg) GROUP BY 1, 2) WHERE n = 2"),
    "s_seeds": _sql("tg", "SELECT graph_id FROM tg ORDER BY md5('2|' || graph_id), graph_id LIMIT 25"),
    "s_weighted_order": f"SELECT c_nationkey, c_custkey, c_acctbal, (row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN round(-ln({_uniform(chr(39) + '3|' + chr(39) + ' || c_nationkey || ' + chr(39) + '|' + chr(39) + ' || c_custkey')}) / c_acctbal, 9) ELSE 'inf'::DOUBLE END, c_custkey))::INTEGER AS pos FROM customer",
    "s_topk": "SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rank FROM orders) WHERE rank <= 10",
    "s_temperature": "SELECT c_nationkey, c_custkey, round(0.5::DOUBLE * greatest(c_acctbal, 0) + 0.5, 6) AS weight FROM customer",
    "s_dedup": _sql("gh", "SELECT hash, min(graph_id) AS first_graph_id, count(*) AS n FROM gh GROUP BY 1"),
    "s_novel": _sql("gh", "SELECT graph_id FROM gh WHERE graph_id % 2 = 1 AND hash NOT IN (SELECT hash FROM gh WHERE graph_id % 2 = 0)"),
    "s_accept_interval": "SELECT key, class, round(p, 6) AS p FROM (SELECT p_partkey AS key, 0 AS class, p_size / 50.0::DOUBLE AS p FROM part UNION ALL SELECT p_partkey, 1, 1 - p_size / 50.0::DOUBLE FROM part) WHERE p BETWEEN 0.4::DOUBLE AND 0.7::DOUBLE",
    "s_unseen": _sql("sk", "SELECT graph_id FROM sk WHERE graph_id % 2 = 1 AND state_key NOT IN (SELECT state_key FROM sk WHERE graph_id % 2 = 0)"),
    "s_beam": "WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS best FROM customer), s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN best > 4 THEN md5('4|' || c_nationkey || '|' || c_custkey) END NULLS FIRST, best) AS chance FROM r) SELECT c_nationkey, c_custkey, c_acctbal, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INTEGER AS rank FROM s WHERE best <= 4 OR chance <= 8",
    "g_components": f"WITH {_FLAG} SELECT graph_id, node_id, component FROM cc",
    "g_largest_component": f"WITH {_FLAG}, z AS (SELECT graph_id, component, count(*) AS n FROM cc GROUP BY 1, 2) SELECT graph_id, count(*) AS n_components, first(component ORDER BY n DESC, component) AS largest, max(n) AS n_nodes FROM z GROUP BY 1",
    "g_shortest_path": "WITH RECURSIVE " + f"nl AS MATERIALIZED ({_BASE['nl']}), w AS MATERIALIZED (SELECT src, dst, w FROM nl UNION ALL SELECT dst, src, w FROM nl), d0 AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS dist), " + ", ".join(f"d{k} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{k - 1} UNION ALL SELECT w.dst, d.dist + w.w FROM d{k - 1} d JOIN w ON d.id = w.src) GROUP BY 1)" for k in range(1, 26)) + " SELECT id, round(dist, 6) AS dist FROM d25",
    "g_node_features": _sql("nd sy sz", "SELECT n.graph_id, n.node_id, round(CASE WHEN z.n_nodes > 1 THEN coalesce(d.deg, 0)::DOUBLE / (z.n_nodes - 1) ELSE 0 END, 6) AS degree, round(CASE WHEN coalesce(d.deg, 0) > 1 THEN 2.0::DOUBLE * coalesce(t.t, 0) / (d.deg * (d.deg - 1)) ELSE 0 END, 6) AS clustering FROM nd n JOIN sz z USING (graph_id) LEFT JOIN (SELECT graph_id, src AS node_id, count(*) AS deg FROM sy GROUP BY 1, 2) d USING (graph_id, node_id) LEFT JOIN (SELECT a.graph_id, a.src AS node_id, count(*) AS t FROM sy a JOIN sy b ON a.graph_id = b.graph_id AND a.src = b.src AND a.dst < b.dst JOIN sy c ON c.graph_id = a.graph_id AND c.src = a.dst AND c.dst = b.dst GROUP BY 1, 2) t USING (graph_id, node_id)"),
    "g_norm_adj": _sql("nd sy", "SELECT a.graph_id, a.src, a.dst, round(1 / sqrt(d.n * e.n), 6) AS v FROM (SELECT graph_id, src, dst FROM sy UNION ALL SELECT graph_id, node_id, node_id FROM nd) a JOIN (SELECT graph_id, node_id, 1 + (SELECT count(*) FROM sy s WHERE s.graph_id = nd.graph_id AND s.src = nd.node_id) AS n FROM nd) d ON a.graph_id = d.graph_id AND a.src = d.node_id JOIN (SELECT graph_id, node_id, 1 + (SELECT count(*) FROM sy s WHERE s.graph_id = nd.graph_id AND s.src = nd.node_id) AS n FROM nd) e ON a.graph_id = e.graph_id AND a.dst = e.node_id"),
    "p_prune_step": _sql("p0 sz", "SELECT graph_id, inode, n_left FROM (SELECT p.graph_id, p.inode, n_nodes - 2 AS n_left, row_number() OVER (PARTITION BY p.graph_id ORDER BY md5('11|' || p.graph_id || '|' || p.inode), p.inode) AS o FROM p0 p JOIN sz ON p.graph_id = sz.graph_id WHERE n_nodes - 2 >= 3) WHERE o = 1"),
    "p_missing_edges": _sql("mi", "SELECT * FROM mi"),
    "p_remove_edges": _sql("ed", "SELECT graph_id, src, dst, label FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5('12|' || graph_id || '|' || src || '|' || dst || '|' || label), src, dst, label) AS rank, count(*) OVER (PARTITION BY graph_id) AS m FROM ed) WHERE rank > round_even(0.5::DOUBLE * m, 0)"),
    "p_edge_neighbors": _sql("ed mi", "SELECT a.graph_id, a.src, a.dst, b.src AS new_src, b.dst AS new_dst FROM (SELECT DISTINCT ON (graph_id) graph_id, src, dst FROM ed ORDER BY graph_id, md5('13|' || graph_id || '|' || src || '|' || dst || '|' || label)) a JOIN (SELECT DISTINCT ON (graph_id) graph_id, src, dst FROM mi ORDER BY graph_id, md5('13|' || graph_id || '|' || src || '|' || dst)) b USING (graph_id)"),
    "p_edge_dataset": _sql("ed", "SELECT graph_id, s.step::INTEGER AS step, m - s.step AS n_edges, 1 AS label FROM (SELECT graph_id, count(*) AS m FROM ed GROUP BY 1), range(0, m + 1) s(step)"),
    "p_beam_step": _sql("mi nd ed", "SELECT graph_id, src, dst, score, rank FROM (SELECT m.graph_id, m.src, m.dst, coalesce(f.score, 0) AS score, (row_number() OVER (PARTITION BY m.graph_id ORDER BY coalesce(f.score, 0) DESC, m.src, m.dst))::INTEGER AS rank FROM mi m JOIN nd a ON m.graph_id = a.graph_id AND m.src = a.node_id JOIN nd b ON m.graph_id = b.graph_id AND m.dst = b.node_id LEFT JOIN (SELECT least(lu, lv) AS la, greatest(lu, lv) AS lb, count(*) AS score FROM ed GROUP BY 1, 2) f ON f.la = least(a.label, b.label) AND f.lb = greatest(a.label, b.label)) WHERE rank <= 3"),
    "p_surgical_blame": _sql("ed", "WITH t AS (SELECT f.graph_id, f.src AS a, s.dst AS b, f.dst AS c FROM ed f JOIN ed s ON f.graph_id = s.graph_id AND s.label = 'seq' AND s.src = f.src JOIN ed r ON f.graph_id = r.graph_id AND r.label = 'seq' AND r.src = s.dst AND r.dst = f.dst WHERE f.label = 'flag') SELECT graph_id, src, dst, n_sets, blame, rank FROM (SELECT graph_id, src, dst, count(*) AS n_sets, round(count(*) / 3.0::DOUBLE, 6) AS blame, (row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, dst DESC, src DESC))::INTEGER AS rank FROM (SELECT graph_id, a AS src, b AS dst FROM t UNION ALL SELECT graph_id, b, c FROM t UNION ALL SELECT graph_id, a, c FROM t) GROUP BY 1, 2, 3) WHERE rank <= 2").replace(" WITH t AS", ", t AS"),
    "p_unify": _sql("ed", "SELECT graph_id, src, dst, first(label ORDER BY moved, label) AS label FROM (SELECT graph_id, least(a, b)::INTEGER AS src, greatest(a, b)::INTEGER AS dst, label, moved FROM (SELECT e.graph_id, CASE WHEN src = l THEN 1 ELSE src END AS a, CASE WHEN dst = l THEN 1 ELSE dst END AS b, label, (src = l OR dst = l)::INTEGER AS moved FROM ed e JOIN (SELECT graph_id, max(dst) AS l FROM ed GROUP BY 1) m ON e.graph_id = m.graph_id WHERE l > 1) WHERE a <> b) GROUP BY 1, 2, 3"),
    "p_components": _sql("cp", "SELECT * FROM cp"),
    "p_ports": _sql("pp cp", "SELECT img_type, port, count(*) AS n FROM (SELECT graph_id, i, j, string_agg(type || 'x' || cnt, ',' ORDER BY type || 'x' || cnt) AS port FROM pp GROUP BY 1, 2, 3) p JOIN cp c ON p.graph_id = c.graph_id AND p.i = c.inode GROUP BY 1, 2"),
    "p_assoc_map": _sql("mb", "SELECT graph_id, node_id, string_agg(inode::VARCHAR, '|' ORDER BY inode) AS inodes FROM mb GROUP BY 1, 2"),
    "p_target_signatures": _sql("pt", "SELECT signature, count(*) AS n FROM (SELECT md5(string_agg(assoc_hash, ',' ORDER BY assoc_hash)) AS signature FROM pt GROUP BY graph_id) GROUP BY 1"),
    "p_seed_node": _sql("cp", "SELECT graph_id, first(inode ORDER BY n, inode) AS inode FROM (SELECT *, count(*) OVER (PARTITION BY img_type, deg) AS n FROM cp) GROUP BY 1"),
    "p_gran_sample": _sql("sz", f"SELECT graph_id, src, dst FROM (SELECT s.graph_id, a.x::INTEGER AS src, b.y::INTEGER AS dst FROM sz s, range(1, s.n_nodes + 1) a(x), range(1, s.n_nodes + 1) b(y) WHERE a.x < b.y) WHERE {_uniform(chr(39) + '14|' + chr(39) + ' || graph_id || ' + chr(39) + '|' + chr(39) + ' || src || ' + chr(39) + '|' + chr(39) + ' || dst')} < 0.3::DOUBLE"),
    "m_beta_schedule": "SELECT i::INTEGER AS epoch, round(least(i / 20.0::DOUBLE, 1.0::DOUBLE) * 0.5, 6) AS beta FROM range(40) t(i)",
    "m_cosine_schedule": "SELECT t, round(beta, 6) AS beta, round(exp(sum(ln(1 - beta)) OVER (ORDER BY t)), 6) AS alpha_bar FROM (SELECT i::INTEGER AS t, least(1 - cos(1.5707963267948966::DOUBLE * (((i + 1) / 52.0::DOUBLE + 0.008::DOUBLE) / 1.008::DOUBLE)) ** 2 / cos(1.5707963267948966::DOUBLE * ((i / 52.0::DOUBLE + 0.008::DOUBLE) / 1.008::DOUBLE)) ** 2, 0.9999::DOUBLE) AS beta FROM range(51) r(i))",
    "m_transition": _sql("em", "SELECT a.label AS i, b.label AS j, round(0.1::DOUBLE * b.p + CASE WHEN a.label = b.label THEN 0.9::DOUBLE ELSE 0 END, 6) AS v FROM em a, em b"),
    "m_posterior": _sql("em", "SELECT x, z, s, round(w / sum(w) OVER (PARTITION BY x, z), 6) AS p FROM (SELECT a.label AS x, b.label AS z, c.label AS s, (0.1::DOUBLE * b.p + CASE WHEN c.label = b.label THEN 0.9::DOUBLE ELSE 0 END) * (0.6::DOUBLE * c.p + CASE WHEN a.label = c.label THEN 0.4::DOUBLE ELSE 0 END) + 1e-7::DOUBLE AS w FROM em a, em b, em c)"),
    "m_vgae_loss": "SELECT l_returnflag, n, round((CASE WHEN pos > 0 THEN (n - pos) / pos ELSE 1 END * lp + ln_) / n, 6) AS loss FROM (SELECT l_returnflag, count(*) AS n, sum(y)::DOUBLE AS pos, sum(CASE WHEN y = 1 THEN -ln(p) ELSE 0 END) AS lp, sum(CASE WHEN y = 0 THEN -ln(1 - p) ELSE 0 END) AS ln_ FROM (SELECT l_returnflag, (l_linestatus = 'O')::INTEGER AS y, least(greatest(l_quantity / 51.0::DOUBLE, 1e-6::DOUBLE), 0.999999::DOUBLE) AS p FROM lineitem) GROUP BY 1)",
    "m_vgae_kl": "SELECT label, count(*) AS n, round(0.5::DOUBLE * avg(v) / count(*), 6) AS kl FROM (SELECT label, list_sum(list_transform(embedding, lambda x: 1 + 2 * (x::DOUBLE / 2 - 1) - x::DOUBLE * x::DOUBLE - exp(2 * (x::DOUBLE / 2 - 1)))) AS v FROM embeddings) GROUP BY label",
    "m_vgae_ranking": """WITH d AS (SELECT l_returnflag, (l_linestatus = 'O')::INTEGER AS y, l_quantity / 51.0::DOUBLE AS p, row_number() OVER (PARTITION BY l_returnflag, l_linestatus = 'O' ORDER BY md5('0|' || l_orderkey || '|' || l_linenumber), l_quantity) AS k FROM lineitem),
        j AS (SELECT a.l_returnflag, ln(1 + exp(b.p - a.p)) AS x FROM d a JOIN d b ON a.l_returnflag = b.l_returnflag AND a.k = b.k AND a.y = 1 AND b.y = 0 AND a.k <= 256)
        SELECT f.l_returnflag, count(x) AS n_pairs, round(coalesce(avg(x), 0), 6) AS loss FROM (SELECT DISTINCT l_returnflag FROM lineitem) f LEFT JOIN j ON f.l_returnflag = j.l_returnflag GROUP BY 1""",
    "m_latent_summary": _sql("pv", "SELECT label, dim::INTEGER AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-4::DOUBLE, 6) AS std FROM (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS dim FROM pv) GROUP BY 1, 2"),
    "m_threshold": "SELECT l_returnflag, round(least(greatest(0.25::DOUBLE + 0.5::DOUBLE * quantile_cont(l_quantity / 51.0::DOUBLE, 0.8), 0.05::DOUBLE), 0.95::DOUBLE), 6) AS threshold FROM lineitem GROUP BY 1",
    "m_encode": _sql("nd", "SELECT graph_id, node_id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS class FROM nd"),
    "m_balanced_accuracy": _sql("lp", "SELECT round(avg(r), 6) AS score, round(greatest((avg(r) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)), 0), 6) AS adjusted FROM (SELECT y, avg((y = z)::INTEGER) AS r FROM lp GROUP BY 1)"),
    "m_f1": _sql("lp", "SELECT n, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) AS n, count(*) FILTER (y = 1 AND z = 1) AS tp, count(*) FILTER (y = 0 AND z = 1) AS fp, count(*) FILTER (y = 1 AND z = 0) AS fn FROM lp)"),
    "m_target_score": "SELECT p_partkey AS key, round(1.0::DOUBLE / (1 + abs(p_size - p_partkey % 50)), 6) AS score FROM part",
    "m_unit_vectors": _sql("pv", "SELECT id, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(x[1] / CASE WHEN sqrt(list_dot_product(x, x)) > 0 THEN sqrt(list_dot_product(x, x)) ELSE 1 END, 6) AS first FROM pv"),
    "m_context_sum": _sql("b1 nd", f"SELECT graph_id, root, bucket, count(*) AS n FROM (SELECT DISTINCT graph_id, root, node_id FROM b1) b JOIN (SELECT graph_id, node_id, {_bits('label', 6)} AS bucket FROM nd) USING (graph_id, node_id) GROUP BY 1, 2, 3"),
    "m_cosine": _sql("nd", f"WITH v AS (SELECT graph_id AS k, {_bits('label', 6)} AS bucket, count(*) AS n FROM nd GROUP BY 1, 2), q AS (SELECT k, sqrt(sum(n * n)::DOUBLE) AS norm FROM v GROUP BY 1), p AS (SELECT k AS a, k + 1 AS b FROM q) SELECT p.a, p.b, round(coalesce(d.dot / (x.norm * y.norm), 0), 6) AS cosine FROM p LEFT JOIN (SELECT l.k AS a, r.k AS b, sum(l.n * r.n)::DOUBLE AS dot FROM v l JOIN v r ON r.k = l.k + 1 AND l.bucket = r.bucket GROUP BY 1, 2) d ON p.a = d.a AND p.b = d.b LEFT JOIN q x ON x.k = p.a LEFT JOIN q y ON y.k = p.b").replace(") WITH v AS", "), v AS"),
    "f_feature_anti": _sql("rh", f"SELECT graph_id, count(*) AS n_violations FROM rh WHERE {_SPLIT} >= 6 AND hash NOT IN (SELECT hash FROM rh WHERE {_SPLIT} < 6) GROUP BY 1"),
    "f_node_range": _sql("sz", f"SELECT graph_id, n_nodes, n_nodes BETWEEN (SELECT min(n_nodes) FROM sz WHERE {_SPLIT} < 6) AND (SELECT max(n_nodes) FROM sz WHERE {_SPLIT} < 6) AS feasible FROM sz WHERE {_SPLIT} >= 6"),
    "f_state_key": _sql("sk", "SELECT * FROM sk"),
    "f_templates": _sql("ed", "SELECT label, count(*) AS n FROM ed GROUP BY 1"),
    "f_validate": _sql("sz", "SELECT graph_id, 'too large' AS problem, n_nodes AS n FROM sz WHERE n_nodes > 10"),
    "w_hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "w_running_weights": "SELECT user_id AS key, round(avg((event_type <> 'error')::INTEGER), 6) AS accept FROM events GROUP BY 1",
    "w_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INTEGER, 1) AS new FROM events)) GROUP BY user_id, s",
    "u_transitions": _sql("ev", "SELECT user_id AS graph_id, event_type AS src, following AS dst, count(*) AS weight FROM ev WHERE following IS NOT NULL GROUP BY 1, 2, 3"),
    "k_rewrite_pairs": _sql("ix", ", d AS (SELECT cut_key, assoc_hash FROM ix WHERE graph_id % 2 = 1 GROUP BY 1, 2), s AS (SELECT cut_key, assoc_hash FROM ix WHERE graph_id % 2 = 0) SELECT cut_key, count(*) AS n_source, count(*) FILTER (EXISTS (SELECT 1 FROM d WHERE d.cut_key = s.cut_key AND d.assoc_hash = s.assoc_hash)) AS n_same FROM s WHERE EXISTS (SELECT 1 FROM d WHERE d.cut_key = s.cut_key AND d.assoc_hash <> s.assoc_hash) GROUP BY 1"),
    "p_replace_single": _sql("ed ix", _CHOICE + " SELECT graph_id, inode, donor_graph, donor_inode, n_nodes, n_edges FROM ch"),
    "p_replace_graph": _sql("ed pt ct ix", _CHOICE + """, bo AS (SELECT h.*, s.u, s.v, d.u AS du, d.v AS dv, d.elabel AS dl, d.lu AS dlu, d.lv AS dlv FROM ch h JOIN pt s ON s.graph_id = h.graph_id AND s.inode = h.inode JOIN pt d ON d.graph_id = h.donor_graph AND d.inode = h.donor_inode),
        sc AS (SELECT h.graph_id, c.*, row_number() OVER (PARTITION BY h.graph_id ORDER BY c.ekey, c.inner_, c.outer_, c.elabel) AS k FROM ch h JOIN (SELECT graph_id AS g, inode AS i, inner_, outer_, elabel, ekey, outer_label FROM ct) c ON c.g = h.graph_id AND c.i = h.inode),
        dc AS (SELECT h.graph_id, c.inner_ AS din, row_number() OVER (PARTITION BY h.graph_id ORDER BY c.ekey, c.inner_, c.outer_, c.elabel) AS k FROM ch h JOIN ct c ON c.graph_id = h.donor_graph AND c.inode = h.donor_inode)
        SELECT e.graph_id, e.src, e.dst, e.label, e.lu, e.lv FROM ed e JOIN bo b ON e.graph_id = b.graph_id WHERE e.src NOT IN (b.u, b.v) AND e.dst NOT IN (b.u, b.v)
        UNION ALL SELECT graph_id, (n_nodes + 1)::INTEGER, (n_nodes + 2)::INTEGER, dl, dlu, dlv FROM bo
        UNION ALL SELECT s.graph_id, s.outer_, (b.n_nodes + CASE WHEN d.din = b.du THEN 1 ELSE 2 END)::INTEGER, s.elabel, s.outer_label, CASE WHEN d.din = b.du THEN b.dlu ELSE b.dlv END FROM sc s JOIN dc d ON s.graph_id = d.graph_id AND s.k = d.k JOIN bo b ON b.graph_id = s.graph_id"""),
    "g_bfs_order": "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({_BASE[n]})" for n in ("nd", "ed", "sy")) + """, w AS MATERIALIZED (SELECT DISTINCT graph_id, src, dst FROM sy),
        st AS (SELECT DISTINCT ON (n.graph_id) n.graph_id, n.node_id FROM nd n LEFT JOIN (SELECT graph_id, src, count(*) AS deg FROM w GROUP BY 1, 2) d ON n.graph_id = d.graph_id AND n.node_id = d.src ORDER BY n.graph_id, coalesce(d.deg, 0) DESC, n.node_id),
        r AS (SELECT graph_id, node_id, 0 AS level FROM st UNION SELECT r.graph_id, w.dst, r.level + 1 FROM r JOIN w ON r.graph_id = w.graph_id AND r.node_id = w.src WHERE r.level < (SELECT max(node_id) FROM nd))
        SELECT n.graph_id, n.node_id, coalesce(min(r.level), -1)::INTEGER AS level FROM nd n LEFT JOIN r ON n.graph_id = r.graph_id AND n.node_id = r.node_id GROUP BY 1, 2""",
    "a_score_rank": _sql("ms", ", dr AS (SELECT model, range AS draw, m1 + 0.1 * s1 * sqrt(-2 * ln(" + _uniform("'x|' || model || '|' || range") + ")) * cos(2 * 3.141592653589793 * " + _uniform("'xb|' || model || '|' || range") + ") AS x, m2 + 0.1 * s2 * sqrt(-2 * ln(" + _uniform("'y|' || model || '|' || range") + ")) * cos(2 * 3.141592653589793 * " + _uniform("'yb|' || model || '|' || range") + ") AS y FROM ms, range(1, 65)) SELECT a.model, count(*) AS wins FROM dr a JOIN dr b ON a.draw = b.draw AND a.model <> b.model AND a.x >= b.x AND a.y >= b.y GROUP BY 1"),
    "a_powerlaw": _FIT,
    "a_path_score": """WITH e AS (SELECT user_id AS path, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
        s AS (SELECT a.path, a.pos, b.pos > a.pos AS way, abs(a.pos - b.pos) AS gap, round(-abs(a.value - b.value), 6) AS sim FROM e a JOIN e b ON a.path = b.path AND a.pos <> b.pos),
        r AS (SELECT path, pos, way, rank() OVER (PARTITION BY path, pos, way ORDER BY gap) + (count(*) OVER (PARTITION BY path, pos, way, gap) - 1) / 2.0 AS rg, rank() OVER (PARTITION BY path, pos, way ORDER BY sim) + (count(*) OVER (PARTITION BY path, pos, way, sim) - 1) / 2.0 AS rs FROM s),
        c AS (SELECT path, corr(rg::DOUBLE, rs::DOUBLE) AS c FROM r GROUP BY path, pos, way HAVING count(*) > 1 AND min(rs) < max(rs)) SELECT path, round(-avg(c), 6) AS score FROM c GROUP BY 1""",
    "p_resume_signature": _sql("gh", "SELECT md5('steps=50|' || sum(('0x' || substr(md5(hash || '|' || n), 1, 8))::BIGINT)) AS signature, sum(n)::BIGINT AS n FROM (SELECT hash, count(*) AS n FROM gh GROUP BY 1)"),
    "s_disjoint_paths": _disjoint_paths(0, 24, 3, 25),
    "g_sparse_neighbors": "WITH RECURSIVE pv AS MATERIALIZED (" + _BASE["pv"] + "), kn AS MATERIALIZED (" + _BASE["kn"] + """), al AS MATERIALIZED (SELECT a.id AS i, b.id AS j, round(list_distance(a.x, b.x), 6) AS w FROM pv a JOIN pv b ON a.id <> b.id),
        pm(id, w, par, done) USING KEY (id) AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM pv) THEN 0.0::DOUBLE ELSE 1e300::DOUBLE END, -1::BIGINT, false FROM pv UNION
        SELECT y.id, CASE WHEN y.id <> x.id AND a.w > 0 AND (a.w, least(x.id, y.id), greatest(x.id, y.id)) < (y.w, least(y.par, y.id), greatest(y.par, y.id)) THEN a.w ELSE y.w END,
            CASE WHEN y.id <> x.id AND a.w > 0 AND (a.w, least(x.id, y.id), greatest(x.id, y.id)) < (y.w, least(y.par, y.id), greatest(y.par, y.id)) THEN x.id ELSE y.par END, y.id = x.id
        FROM (SELECT * FROM recurring.pm WHERE NOT done) y, (SELECT * FROM recurring.pm WHERE NOT done ORDER BY w, least(par, id), greatest(par, id) LIMIT 1) x LEFT JOIN al a ON a.i = x.id AND a.j = y.id)
        SELECT src, dst, min(w) AS w FROM (SELECT least(id, par) AS src, greatest(id, par) AS dst, w FROM pm WHERE par >= 0 UNION ALL SELECT a.i, a.j, a.d FROM kn a JOIN kn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j AND a.d > 0) GROUP BY 1, 2""",
    "g_traversal_order": "WITH " + _FLAG + """, rk AS MATERIALIZED (SELECT n.graph_id, n.node_id, row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(d.deg, 0) DESC, n.node_id) - 1 AS r FROM nd n LEFT JOIN (SELECT graph_id, src, count(DISTINCT dst) AS deg FROM fs GROUP BY 1, 2) d ON n.graph_id = d.graph_id AND n.node_id = d.src),
        st AS MATERIALIZED (SELECT r.graph_id, c.component AS label, min(r.r) AS r FROM rk r JOIN cc c USING (graph_id, node_id) GROUP BY 1, 2), sn AS MATERIALIZED (SELECT s.graph_id, s.label, k.node_id, k.r, (row_number() OVER (PARTITION BY s.graph_id ORDER BY s.r) - 1)::INTEGER AS component FROM st s JOIN rk k ON s.graph_id = k.graph_id AND s.r = k.r),
        bl AS (SELECT graph_id, node_id, 0 AS level FROM sn UNION SELECT b.graph_id, f.dst, b.level + 1 FROM bl b JOIN fs f ON b.graph_id = f.graph_id AND b.node_id = f.src WHERE b.level < (SELECT max(node_id) FROM nd)),
        lv AS MATERIALIZED (SELECT graph_id, node_id, min(level)::INTEGER AS level FROM bl GROUP BY 1, 2),
        wk AS (SELECT graph_id, node_id, 0 AS level, lpad(r::VARCHAR, 6, '0') AS path FROM sn UNION SELECT w.graph_id, l.node_id, w.level + 1, w.path || lpad(k.r::VARCHAR, 6, '0') FROM wk w JOIN fs f ON w.graph_id = f.graph_id AND w.node_id = f.src JOIN lv l ON l.graph_id = f.graph_id AND l.node_id = f.dst AND l.level = w.level + 1 JOIN rk k ON k.graph_id = l.graph_id AND k.node_id = l.node_id)
        SELECT p.graph_id, p.node_id, s.component, l.level, (row_number() OVER (PARTITION BY p.graph_id ORDER BY s.component, l.level, p.path) - 1)::INTEGER AS pos
        FROM (SELECT graph_id, node_id, min(path) AS path FROM wk GROUP BY 1, 2) p JOIN lv l USING (graph_id, node_id) JOIN cc c USING (graph_id, node_id) JOIN sn s ON s.graph_id = c.graph_id AND s.label = c.component""",
    "g_mst_knn": "WITH RECURSIVE nl AS MATERIALIZED (" + _BASE["nl"] + """), el AS MATERIALIZED (SELECT src, dst, w, row_number() OVER (ORDER BY w, src, dst) AS k FROM nl), wy AS MATERIALIZED (SELECT src, dst, k FROM el UNION ALL SELECT dst, src, k FROM el),
        re AS (SELECT k, src AS node FROM el UNION SELECT r.k, y.dst FROM re r JOIN wy y ON y.src = r.node AND y.k < r.k) SELECT e.src, e.dst, round(e.w, 6) AS w FROM el e WHERE NOT EXISTS (SELECT 1 FROM re r WHERE r.k = e.k AND r.node = e.dst)""",
    "a_eds": "WITH ft AS (" + _FIT + """), pg AS (SELECT l_returnflag AS key, l_linenumber::BIGINT AS n, round(avg(l_quantity), 6) AS y FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
        x AS (SELECT key, n, (pow(abs(b) / greatest(CASE WHEN b < 0 THEN a - y ELSE y - a END, 0, 0.001::DOUBLE * greatest(abs(a), abs(b), 1)), 1 / alpha) - n) / n AS r, abs(b * pow(2.0::DOUBLE * n, -alpha) - b * pow(n, -alpha)) AS gain FROM pg JOIN ft USING (key)),
        g AS (SELECT *, CASE WHEN gain > quantile_cont(gain, 0.25) OVER (PARTITION BY key) THEN gain ELSE 0 END AS g FROM x) SELECT key, round(sum(g * r) / sum(g), 4) AS eds FROM g GROUP BY 1""",
    "j_injective": _sql("pp", ", a AS (SELECT DISTINCT graph_id, i, j FROM pp WHERE type = 'PROMO'), b AS (SELECT DISTINCT graph_id, i, j FROM pp WHERE type = 'STANDARD') SELECT graph_id, i, (min((a.j::BIGINT * 100000 + b.j)) // 100000)::VARCHAR || ',' || (min((a.j::BIGINT * 100000 + b.j)) % 100000)::VARCHAR AS ports FROM a JOIN b USING (graph_id, i) WHERE a.j <> b.j GROUP BY 1, 2"),
    "j_virtual_match": _sql("nd ct", ", fo AS (SELECT DISTINCT ON (graph_id, inode, outer_) graph_id, inode, outer_, outer_label FROM ct WHERE graph_id % 2 = 1 ORDER BY graph_id, inode, outer_, inner_, elabel), vk AS (SELECT graph_id, inode, string_agg(outer_label, ';' ORDER BY outer_label) AS cut_key FROM fo GROUP BY 1, 2 HAVING count(*) = 2), dn AS (SELECT cut_key, graph_id AS donor_graph, inode AS donor_inode, row_number() OVER (PARTITION BY cut_key ORDER BY graph_id, inode) AS draw, count(*) OVER (PARTITION BY cut_key) AS n_donors FROM vk), pa AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, least(a.label, b.label) || ';' || greatest(a.label, b.label) AS cut_key FROM nd a JOIN nd b ON a.graph_id = b.graph_id AND a.node_id < b.node_id WHERE a.graph_id % 2 = 0) SELECT p.graph_id, p.a, p.b, p.cut_key, d.n_donors, d.donor_graph, d.donor_inode FROM pa p JOIN dn d ON p.cut_key = d.cut_key AND d.draw = floor(" + _uniform("'21|' || p.graph_id || '|' || p.a || '|' || p.b") + " * d.n_donors)::BIGINT + 1"),
    "g_connect_all": f"WITH {_FLAG}, z AS (SELECT DISTINCT graph_id, component FROM cc), y AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY component) AS r FROM z) SELECT a.graph_id, a.component AS src, b.component AS dst FROM y a JOIN y b ON a.graph_id = b.graph_id AND a.r = 1 AND b.r > 1",
    "p_edge_prefixes": _sql("ed", _ORDER_OF_REMOVAL + " SELECT graph_id, s.step::INTEGER AS step, src, dst, label FROM ro, range(0, rank) s(step)"),
    "p_edge_negatives": _sql("ed mi", _ORDER_OF_REMOVAL + """, px AS (SELECT graph_id, s.step, src, dst, label FROM ro, range(0, rank) s(step)),
        mv AS (SELECT DISTINCT ON (graph_id, step) graph_id, step, src, dst FROM px ORDER BY graph_id, step, md5('22|' || graph_id || '|' || step || '|' || src || '|' || dst || '|' || label)),
        fr AS (SELECT q.graph_id, q.step, p.src, p.dst FROM (SELECT DISTINCT graph_id, step FROM px) q JOIN (SELECT graph_id, src, dst FROM mi UNION SELECT graph_id, src, dst FROM ed) p ON p.graph_id = q.graph_id WHERE NOT EXISTS (SELECT 1 FROM px x WHERE x.graph_id = q.graph_id AND x.step = q.step AND x.src = p.src AND x.dst = p.dst)),
        ff AS (SELECT DISTINCT ON (graph_id, step) graph_id, step, src, dst FROM fr ORDER BY graph_id, step, md5('22|' || graph_id || '|' || step || '|' || src || '|' || dst))
        SELECT m.graph_id, m.step::INTEGER AS step, m.src, m.dst, f.src AS new_src, f.dst AS new_dst FROM mv m JOIN ff f ON m.graph_id = f.graph_id AND m.step = f.step"""),
}


def _recursive(uses: str, tables: str, body: str) -> str:
    """body after the common tables that uses names and further tables, which may be recursive."""
    return "WITH RECURSIVE " + _sql(uses, "").removeprefix("WITH ").rstrip() + ", " + tables + " " + body


_STRUCTURE = """wk AS (SELECT graph_id, node_id AS root, node_id, 0 AS d FROM nd UNION SELECT w.graph_id, w.root, s.dst, w.d + 1 FROM wk w JOIN sy s ON s.graph_id = w.graph_id AND s.src = w.node_id JOIN sz z ON z.graph_id = w.graph_id WHERE w.d + 1 < z.n_nodes),
    ds AS MATERIALIZED (SELECT graph_id, root, node_id, min(d) AS d FROM wk GROUP BY 1, 2, 3),
    ps AS (SELECT graph_id, node_id AS root, node_id, 0 AS d FROM nd UNION ALL SELECT p.graph_id, p.root, s.dst, p.d + 1 FROM ps p JOIN sy s ON s.graph_id = p.graph_id AND s.src = p.node_id JOIN ds ON ds.graph_id = p.graph_id AND ds.root = p.root AND ds.node_id = s.dst AND ds.d = p.d + 1),
    sp AS MATERIALIZED (SELECT graph_id, root, node_id, d, count(*) AS c FROM ps GROUP BY 1, 2, 3, 4),
    th AS (SELECT a.graph_id, a.node_id, sum(a.c * b.c / c.c::DOUBLE) AS through FROM sp a JOIN sp b ON a.graph_id = b.graph_id AND a.node_id = b.root JOIN sp c ON c.graph_id = a.graph_id AND c.root = a.root AND c.node_id = b.node_id
           WHERE a.root <> a.node_id AND b.node_id <> a.node_id AND a.root <> b.node_id AND a.d + b.d = c.d GROUP BY 1, 2),
    bt AS (SELECT n.graph_id, n.node_id, CASE WHEN z.n_nodes > 2 THEN coalesce(t.through, 0) / ((z.n_nodes - 1) * (z.n_nodes - 2)) ELSE 0 END::DOUBLE AS betweenness FROM nd n JOIN sz z USING (graph_id) LEFT JOIN th t USING (graph_id, node_id)),
    nf AS (SELECT n.graph_id, n.node_id, (CASE WHEN z.n_nodes > 1 THEN coalesce(d.deg, 0)::DOUBLE / (z.n_nodes - 1) ELSE 0 END)::DOUBLE AS degree, (CASE WHEN coalesce(d.deg, 0) > 1 THEN 2.0::DOUBLE * coalesce(t.t, 0) / (d.deg * (d.deg - 1)) ELSE 0 END)::DOUBLE AS clustering FROM nd n JOIN sz z USING (graph_id)
           LEFT JOIN (SELECT graph_id, src AS node_id, count(*) AS deg FROM sy GROUP BY 1, 2) d USING (graph_id, node_id) LEFT JOIN (SELECT a.graph_id, a.src AS node_id, count(*) AS t FROM sy a JOIN sy b ON a.graph_id = b.graph_id AND a.src = b.src AND a.dst < b.dst JOIN sy c ON c.graph_id = a.graph_id AND c.src = a.dst AND c.dst = b.dst GROUP BY 1, 2) t USING (graph_id, node_id))"""
_SCALED = ", ".join(f"round(({c} - (SELECT avg({c}) FROM ft)) / (SELECT stddev_pop({c}) FROM ft), 6) AS {c}" for c in ("degree", "clustering", "betweenness"))
_DRAWN = "(i * c[3]) // least(c[3], 8) + floor({u} * (((i + 1) * c[3]) // least(c[3], 8) - (i * c[3]) // least(c[3], 8)))::BIGINT"

ORACLE_SQL |= {
    "g_betweenness": _recursive("nd sy sz", _STRUCTURE, "SELECT graph_id, node_id, round(betweenness, 6) AS betweenness FROM bt"),
    "g_scaled_features": _recursive("nd sy sz", _STRUCTURE + ", ft AS MATERIALIZED (SELECT nf.*, betweenness FROM nf JOIN bt USING (graph_id, node_id))", f"SELECT graph_id, node_id, {_SCALED} FROM ft"),
    "k_virtual_candidates_3": _sql("vk cb", "SELECT cut_key, n_sets, n_entries FROM (SELECT cut_key, count(*) AS n_sets FROM cb WHERE k = 3 GROUP BY 1) JOIN (SELECT cut_key, count(*) AS n_entries FROM vk WHERE k = 3 GROUP BY 1) USING (cut_key)"),
    "k_virtual_sample": _sql("vk cb ch3", "SELECT s.graph_id, b.nodes, b.cut_key, v.n_entries FROM (SELECT graph_id, " + _DRAWN.format(u=_uniform("'31|' || graph_id || '|' || i")) + " AS rank FROM (SELECT graph_id, c, unnest(range(least(c[3], 8))) AS i FROM ch3 WHERE n >= 3)) s JOIN cb b ON b.graph_id = s.graph_id AND b.k = 3 AND b.rank = s.rank JOIN (SELECT cut_key, count(*) AS n_entries FROM vk WHERE k = 3 GROUP BY 1) v ON v.cut_key = b.cut_key"),
    "p_virtual_propose": _sql("vk cb ch3", """, ov AS (SELECT * FROM vk WHERE graph_id % 2 = 1 AND k <= 3), sw AS (SELECT [count(*) FILTER (k <= 1), count(*) FILTER (k <= 2), count(*)] AS w FROM ov),
        kn AS (SELECT cut_key, count(*) AS n_donors FROM ov GROUP BY 1), dn AS (SELECT cut_key, graph_id AS donor_graph, inode AS donor_inode, row_number() OVER (PARTITION BY cut_key ORDER BY graph_id, inode) AS draw FROM ov),
        a1 AS (SELECT graph_id, n, c, t.t AS attempt, len(list_filter(w, lambda x: x <= floor({size} * w[least(n, 3)]))) + 1 AS k FROM ch3, sw, range(1, 13) t(t) WHERE graph_id % 2 = 0),
        a2 AS (SELECT * FROM a1 UNION ALL SELECT graph_id, n, c, 12 + k.k, k.k FROM ch3, range(1, 4) k(k) WHERE graph_id % 2 = 0),
        a3 AS (SELECT graph_id, attempt, k, floor({draw} * c[k])::BIGINT AS rank FROM a2 WHERE k <= n AND k <= 3),
        tr AS (SELECT a3.graph_id, attempt, a3.k, nodes, cb.cut_key, n_donors FROM a3 JOIN cb ON cb.graph_id = a3.graph_id AND cb.k = a3.k AND cb.rank = a3.rank LEFT JOIN kn ON kn.cut_key = cb.cut_key),
        mn AS (SELECT * FROM (SELECT *, count(n_donors) OVER w AS hits, count(*) OVER w - count(n_donors) OVER w AS missed FROM tr WHERE attempt <= 12 WINDOW w AS (PARTITION BY graph_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE hits < 2 AND missed < 6),
        sf AS (SELECT t.*, coalesce((SELECT count(n_donors) FROM mn WHERE mn.graph_id = t.graph_id), 0) AS got FROM tr t WHERE attempt > 12 AND NOT EXISTS (SELECT 1 FROM mn WHERE mn.graph_id = t.graph_id AND mn.k = t.k)),
        sx AS (SELECT * FROM (SELECT *, got + count(n_donors) OVER (PARTITION BY graph_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hits FROM sf) WHERE hits < 2),
        kp AS (SELECT graph_id, attempt, k, nodes, cut_key, n_donors FROM mn UNION ALL SELECT graph_id, attempt, k, nodes, cut_key, n_donors FROM sx)
        SELECT kp.graph_id, attempt::INTEGER AS attempt, k::INTEGER AS k, nodes, kp.cut_key, n_donors, donor_graph, donor_inode FROM kp JOIN dn ON dn.cut_key = kp.cut_key AND dn.draw = floor({donor} * n_donors)::BIGINT + 1 WHERE n_donors IS NOT NULL"""
        .format(size=_uniform("'32|size|' || graph_id || '|' || t.t"), draw=_uniform("'32|set|' || graph_id || '|' || attempt"), donor=_uniform("'32|donor|' || kp.graph_id || '|' || attempt"))),
    "j_retrieve": _sql("pp tg", """, pg AS (SELECT graph_id, i, j, string_agg(type || '*' || cnt, '+' ORDER BY type) AS sig FROM pp GROUP BY 1, 2, 3), si AS (SELECT DISTINCT sig, type, cnt FROM pg JOIN pp USING (graph_id, i, j)),
        cn AS (SELECT a.sig, b.sig AS big FROM si a JOIN si b ON a.type = b.type AND b.cnt >= a.cnt GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM si c WHERE c.sig = a.sig)),
        pf AS (SELECT graph_id, i, string_agg(DISTINCT sig, ' ' ORDER BY sig) AS profile FROM pg GROUP BY 1, 2), of AS (SELECT DISTINCT profile, sig FROM pf JOIN pg USING (graph_id, i)), own AS (SELECT pf.* FROM pf JOIN tg USING (graph_id) WHERE target = 'P'),
        held AS (SELECT profile, count(*) AS n FROM pf JOIN tg USING (graph_id) WHERE target <> 'P' GROUP BY 1),
        ok AS (SELECT a.profile, b.profile AS holder FROM (SELECT * FROM of WHERE profile IN (SELECT profile FROM own)) a JOIN cn USING (sig) JOIN (SELECT * FROM of WHERE profile IN (SELECT profile FROM held)) b ON b.sig = cn.big GROUP BY 1, 2 HAVING count(DISTINCT a.sig) = (SELECT count(*) FROM of WHERE of.profile = a.profile))
        SELECT own.graph_id, own.i AS inode, sum(held.n)::BIGINT AS n_candidates FROM own JOIN ok USING (profile) JOIN held ON held.profile = ok.holder GROUP BY 1, 2"""),
}


def _index(before: str, members: str, key: str) -> str:
    """The index of subgraphs by members (graph_id, inode, node_id), boundary edges known by key; before: what defines nd, sy and more."""
    at = "x.graph_id = m.graph_id AND x.inode = m.inode"
    rounds = ", ".join(
        f"v{k} AS MATERIALIZED (SELECT n.graph_id, n.inode, n.node_id, md5(n.h || '|' || coalesce(string_agg(i.label || ':' || m.h, ',' ORDER BY i.label || ':' || m.h), '')) AS h FROM v{k - 1} n LEFT JOIN iw i ON n.graph_id = i.graph_id AND n.inode = i.inode AND n.node_id = i.src LEFT JOIN v{k - 1} m ON i.graph_id = m.graph_id AND i.inode = m.inode AND i.dst = m.node_id GROUP BY n.graph_id, n.inode, n.node_id, n.h)"
        for k in (1, 2, 3)
    )
    return before + f""", mm AS MATERIALIZED ({members}), iw AS MATERIALIZED (SELECT m.graph_id, m.inode, s.src, s.dst, s.label FROM mm m JOIN sy s ON s.graph_id = m.graph_id AND s.src = m.node_id JOIN mm x ON {at} AND x.node_id = s.dst),
        v0 AS MATERIALIZED (SELECT mm.graph_id, inode, node_id, label AS h FROM mm JOIN nd USING (graph_id, node_id)), {rounds},
        bd AS (SELECT m.graph_id, m.inode, m.node_id, {key} AS ekey FROM mm m JOIN sy s ON s.graph_id = m.graph_id AND s.src = m.node_id WHERE NOT EXISTS (SELECT 1 FROM mm x WHERE {at} AND x.node_id = s.dst)),
        cu AS (SELECT bd.graph_id, bd.inode, string_agg(ekey, ';' ORDER BY ekey) AS cut_key, md5(string_agg(ekey || '@' || h, ';' ORDER BY ekey || '@' || h)) AS sig FROM bd JOIN v3 USING (graph_id, inode, node_id) GROUP BY 1, 2),
        hs AS (SELECT graph_id, inode, md5(string_agg(h, ',' ORDER BY h)) AS assoc_hash FROM v3 GROUP BY 1, 2)
        SELECT graph_id, inode, coalesce(cut_key, '') AS cut_key, assoc_hash, coalesce(sig, md5('')) AS edge_map_sig FROM hs LEFT JOIN cu USING (graph_id, inode)"""


_NEAR = "1 / (1 + list_distance({a}, {b}))"
_SCORED = "SELECT id, x, (id % 17) / 17.0::DOUBLE AS score, len(list_filter(x, lambda v: v > 0)) AS wins, len(x) AS n FROM pv"


def _greedy(points: str, k: int, start: str, near: str, best: str, columns: str = "score") -> str:
    """(rank, id) of k picks from points (id, x, columns): each first by best, over a running column close that near gives from start."""
    out = f", s0 AS MATERIALIZED (SELECT id, x, {columns}, {start} AS close FROM ({points}))"
    for i in range(1, k + 1):
        taken = " AND ".join(f"id NOT IN (SELECT id FROM p{j})" for j in range(1, i)) or "true"
        out += f", p{i} AS MATERIALIZED (SELECT id, x FROM s{i - 1} WHERE {taken} ORDER BY {best if i > 1 or columns == 'score' else columns}, id LIMIT 1), s{i} AS MATERIALIZED (SELECT s.id, s.x, {columns}, {near} AS close FROM s{i - 1} s, p{i} p)"
    return out + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS rank, id FROM p{i}" for i in range(1, k + 1))


def _swaps(rounds: int, worst: int, d: float) -> str:
    near = _NEAR.format(a="a.x", b="b.x")
    out = f", pts AS MATERIALIZED ({_SCORED}), m0 AS MATERIALIZED (SELECT id, x, score FROM pts ORDER BY score DESC, id LIMIT 6)"
    for r in range(rounds):
        out += f""", l{r} AS MATERIALIZED (SELECT a.id, a.score, max({near}) AS mx FROM m{r} a JOIN m{r} b ON a.id <> b.id GROUP BY 1, 2), w{r} AS (SELECT id AS old FROM l{r} ORDER BY round(score - {d}::DOUBLE * mx, 9), id LIMIT {worst}),
            c{r} AS (SELECT old, id AS new FROM w{r}, pts WHERE id NOT IN (SELECT id FROM m{r})), t{r} AS MATERIALIZED (SELECT old, new, m.id, m.x, m.score FROM c{r} JOIN m{r} m ON m.id <> old UNION ALL SELECT old, new, p.id, p.x, p.score FROM c{r} JOIN pts p ON p.id = new),
            r{r} AS (SELECT old, new, sum(score) - {d}::DOUBLE * sum(mx) AS reward FROM (SELECT a.old, a.new, a.id, a.score, max({near}) AS mx FROM t{r} a JOIN t{r} b ON a.old = b.old AND a.new = b.new AND a.id <> b.id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
            b{r} AS MATERIALIZED (SELECT old, new FROM (SELECT * FROM r{r} ORDER BY round(reward, 9) DESC, new, old LIMIT 1) WHERE round(reward, 9) > (SELECT sum(score) - {d}::DOUBLE * sum(mx) FROM l{r}) + 1e-9),
            m{r + 1} AS MATERIALIZED (SELECT * FROM m{r} WHERE id NOT IN (SELECT old FROM b{r}) UNION ALL SELECT id, x, score FROM pts WHERE id IN (SELECT new FROM b{r}))"""
    return out + f" SELECT id FROM m{rounds}"


def _growth(steps: int) -> str:
    out = ", mx AS MATERIALIZED (SELECT mi.graph_id, mi.src, mi.dst, least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb FROM mi JOIN nd a ON a.graph_id = mi.graph_id AND a.node_id = mi.src JOIN nd b ON b.graph_id = mi.graph_id AND b.node_id = mi.dst), e0 AS MATERIALIZED (SELECT least(lu, lv) AS la, greatest(lu, lv) AS lb FROM ed)"
    for k in range(1, steps + 1):
        taken = " AND ".join(f"NOT EXISTS (SELECT 1 FROM a{j} a WHERE a.graph_id = mx.graph_id AND a.src = mx.src AND a.dst = mx.dst)" for j in range(1, k)) or "true"
        out += f""", f{k} AS (SELECT la, lb, count(*) AS n FROM e{k - 1} GROUP BY 1, 2), a{k} AS MATERIALIZED (SELECT DISTINCT ON (graph_id) graph_id, src, dst, la, lb, coalesce(n, 0) AS score FROM mx LEFT JOIN f{k} USING (la, lb) WHERE {taken} ORDER BY graph_id, score DESC, src, dst),
            e{k} AS MATERIALIZED (SELECT la, lb FROM e{k - 1} UNION ALL SELECT la, lb FROM a{k})"""
    return out + " " + " UNION ALL ".join(f"SELECT graph_id, {k}::INTEGER AS step, src, dst, score FROM a{k}" for k in range(1, steps + 1))


def _diffusion(betas: list[float]) -> str:
    bars, bar = [], 1.0
    for b in betas:
        bar *= 1 - b
        bars.append(bar)
    times = ", ".join(f"({t + 1}, {b!r}::DOUBLE, {bars[t]!r}::DOUBLE, {(bars[t - 1] if t else 1.0)!r}::DOUBLE)" for t, b in enumerate(betas))
    same = "CASE WHEN {a} = {b} THEN {w} ELSE 0 END"
    u = lambda what: _uniform(f"'37|{what}|' || graph_id || '|' || node_id || '|' || t")
    return f""", ml AS MATERIALIZED (SELECT label, n / sum(n) OVER () AS p, sum(n) OVER () AS a FROM (SELECT label, count(*)::DOUBLE AS n FROM nd GROUP BY 1)), tm(t, beta, bar, before) AS (VALUES {times}),
        rw AS (SELECT t, x.label AS x, z.label AS z, s.label AS s, (beta * z.p + {same.format(a="s.label", b="z.label", w="1 - beta")}) * ((1 - before) * s.p + {same.format(a="x.label", b="s.label", w="before")}) + 1e-7::DOUBLE AS w FROM tm, ml x, ml z, ml s),
        qs AS MATERIALIZED (SELECT t, x, z, s, w / sum(w) OVER (PARTITION BY t, x, z) AS q FROM rw), me AS (SELECT t, z, s, sum(q * p) AS m FROM qs JOIN ml ON ml.label = x GROUP BY 1, 2, 3),
        lo AS MATERIALIZED (SELECT t, x, z, {len(betas)} * sum(q * ln(q / (0.5::DOUBLE * q + 0.5::DOUBLE * m))) AS loss FROM qs JOIN me USING (t, z, s) GROUP BY 1, 2, 3),
        la AS (SELECT x.label AS x, (1 - {bars[-1]!r}::DOUBLE) * s.p + {same.format(a="x.label", b="s.label", w=f"{bars[-1]!r}::DOUBLE")} + 1e-7::DOUBLE AS q, s.p + 1e-7::DOUBLE AS m FROM ml x, ml s),
        kp AS (SELECT x, sum(q * ln(q / m)) AS kl FROM (SELECT x, q / sum(q) OVER (PARTITION BY x) AS q, m / sum(m) OVER (PARTITION BY x) AS m FROM la) GROUP BY 1),
        lz AS (SELECT label AS x, ln((0.5::DOUBLE + 0.5::DOUBLE * p + 1e-7::DOUBLE) / (1 + 1e-7::DOUBLE * (SELECT count(*) FROM ml))) AS lp FROM ml),
        cm AS (SELECT list(struct_pack(upto := upto, label := label) ORDER BY label) AS c FROM (SELECT label, sum(p) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS upto FROM ml)),
        dr AS (SELECT graph_id, t, label AS x, CASE WHEN {u("keep")} < bar THEN label ELSE coalesce(list_filter(c, lambda y: y.upto > {u("label")})[1].label, c[-1].label) END AS z FROM nd, tm, cm),
        te AS (SELECT graph_id, t, sum(kl) AS kl_prior, sum(loss) AS loss_t, sum(lp) AS log_p0, count(*) AS n FROM dr JOIN lo USING (t, x, z) JOIN kp USING (x) JOIN lz USING (x) GROUP BY 1, 2),
        sn AS (SELECT n_nodes AS n, ln(count(*)::DOUBLE / (SELECT count(*) FROM sz)) AS log_pn FROM sz GROUP BY 1)
        SELECT graph_id, t::INTEGER AS t, round(log_pn, 5) AS log_pn, round(kl_prior, 5) AS kl_prior, round(loss_t, 5) AS loss_t, round(log_p0, 5) AS log_p0, round(-log_pn + kl_prior + loss_t - log_p0, 5) AS nll FROM te JOIN sn USING (n)"""


_BETA = "list_sort(list_transform(range(1, n + 2), lambda i: " + _uniform("'33|' || id || '|' || i") + "))[wins + 1]"
_BOTH = "s.label || '|' || s.lu || '|' || s.lv"

ORACLE_SQL |= {
    "p_mmr_select": _sql("pv", _greedy(_SCORED, 8, "0::DOUBLE", "greatest(s.close, " + _NEAR.format(a="s.x", b="p.x") + ")", "round(score - 0.7::DOUBLE * close, 9) DESC")),
    "p_thompson_select": _sql("pv", _greedy(f"SELECT id, x, {_BETA} + 0.5::DOUBLE * score AS score FROM ({_SCORED})", 6, "0::DOUBLE", "greatest(s.close, " + _NEAR.format(a="s.x", b="p.x") + ")", "round(score - 0.7::DOUBLE * close, 9) DESC")),
    "p_swap_refine": _sql("pv", _swaps(2, 2, 0.7)),
    "s_farthest_point": _sql("pv", _greedy("SELECT id, list_transform(x, lambda v: v / coalesce(nullif(sqrt(list_sum(list_transform(x, lambda w: w * w))), 0), 1)) AS x, md5('5|' || id) AS h FROM pv", 8, "'inf'::DOUBLE", "least(s.close, round(1 - list_dot_product(s.x, p.x), 9))", "close DESC", "h")),
    "p_grow": _sql("mi nd", _growth(3)),
    "p_prune_sequence": _recursive("ed sy sz", """od AS MATERIALIZED (SELECT graph_id, src AS u, dst AS v, row_number() OVER (PARTITION BY graph_id ORDER BY md5('34|' || graph_id || '|' || src || '|' || dst || '|' || label), src, dst, label) AS r FROM ed),
        st AS (SELECT graph_id, 0::BIGINT AS r, []::INTEGER[] AS used, 0 AS step, n_nodes, NULL::INTEGER AS u, NULL::INTEGER AS v, false AS took FROM sz UNION ALL
               SELECT graph_id, r, CASE WHEN ok THEN list_concat(used, [u, v]) ELSE used END, step + ok::INTEGER, n_nodes, u, v, ok FROM (SELECT s.graph_id, o.r, s.used, s.step, s.n_nodes, o.u, o.v, NOT list_contains(s.used, o.u) AND NOT list_contains(s.used, o.v) AND s.n_nodes - 2 * (s.step + 1) >= 3 AS ok FROM st s JOIN od o ON o.graph_id = s.graph_id AND o.r = s.r + 1)),
        pk AS (SELECT * FROM st WHERE took), ou AS (SELECT DISTINCT p.graph_id, p.step, s.dst, s.lv FROM pk p JOIN sy s ON s.graph_id = p.graph_id AND (s.src = p.u OR s.src = p.v) WHERE NOT list_contains(p.used, s.dst)),
        oc AS (SELECT graph_id, step, count(*) AS cut_size, string_agg(lv, ';' ORDER BY lv) AS cut_key FROM ou GROUP BY 1, 2)""",
        "SELECT graph_id, step, u, v, n_nodes - 2 * step AS n_left, coalesce(cut_size, 0) AS cut_size, coalesce(cut_key, '') AS cut_key FROM pk LEFT JOIN oc USING (graph_id, step)"),
    "k_index_neighbourhood": _index(_sql("nd sy", "").rstrip(), "SELECT DISTINCT graph_id, node_id AS inode, node_id FROM nd UNION SELECT graph_id, src, dst FROM sy", _BOTH),
    "k_index_triangle": _index(_sql("nd ed sy", "").rstrip(), "SELECT graph_id, (row_number() OVER (PARTITION BY graph_id ORDER BY a, b, c))::INTEGER AS inode, unnest([a, b, c]) AS node_id FROM (SELECT x.graph_id, x.src AS a, x.dst AS b, y.dst AS c FROM ed x JOIN ed y ON x.graph_id = y.graph_id AND x.dst = y.src JOIN ed z ON z.graph_id = x.graph_id AND z.src = x.src AND z.dst = y.dst)", "s.label || '|' || s.lu"),
    "k_index_component": _index("WITH " + _FLAG + f", ed AS MATERIALIZED ({_BASE['ed']}), sy AS MATERIALIZED ({_BASE['sy']})", "SELECT graph_id, component AS inode, node_id FROM cc", "s.label"),
    "a_bootstrap": _sql("tg", ", pl AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY graph_id) AS pos, count(*) OVER (PARTITION BY target) AS size FROM tg), dr AS (SELECT target, floor(" + _uniform("'35|' || target || '|' || pos") + " * size)::BIGINT + 1 AS pos FROM pl) SELECT target, graph_id, count(*) AS times FROM dr JOIN pl USING (target, pos) GROUP BY 1, 2"),
    "a_resample": _sql("tg", "SELECT target, graph_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('36|' || graph_id), graph_id) AS pos, count(*) OVER (PARTITION BY target) AS n FROM tg) WHERE n - 100 < 3 OR pos <= 100"),
    "m_diffusion_nll": _sql("nd sz", _diffusion([0.1, 0.3, 0.6])),
}

_BUCKET3, _BUCKET6 = (_bits("label", n) for n in (3, 6))
_LABELS = "SELECT lb.label, ({b6}) AS b6, ({b3}) AS b3 FROM (SELECT DISTINCT label FROM nd) lb".format(b6=_BUCKET6, b3=_BUCKET3)
_COSINE = "round(list_dot_product({x}, mean) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product(mean, mean))), 9)"
_REPAIR = f""", lb AS MATERIALIZED ({_LABELS}), gv AS MATERIALIZED (SELECT graph_id, list(n ORDER BY b) AS x FROM (SELECT g.graph_id, r.b, count(lb.label)::DOUBLE AS n FROM (SELECT DISTINCT graph_id FROM nd) g CROSS JOIN range(64) r(b) LEFT JOIN (SELECT graph_id, lb.label, b6 FROM nd JOIN lb USING (label)) lb ON lb.graph_id = g.graph_id AND lb.b6 = r.b GROUP BY 1, 2) GROUP BY 1),
    gu AS MATERIALIZED (SELECT graph_id, x, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u, target FROM gv JOIN tg USING (graph_id)),
    vu AS MATERIALIZED (SELECT u, min(graph_id) AS v FROM gu WHERE target IN ('P', 'F') GROUP BY u), gw AS MATERIALIZED (SELECT graph_id, target, v FROM gu JOIN vu USING (u)),
    fd AS MATERIALIZED (SELECT v, graph_id FROM (SELECT v, graph_id, row_number() OVER (PARTITION BY v ORDER BY graph_id) AS r FROM gw WHERE target = 'F') WHERE r <= 5),
    dv AS MATERIALIZED (SELECT a.v, b.v AS w, round(list_distance(a.u, b.u), 9) AS d FROM vu a, vu b WHERE a.v IN (SELECT v FROM gw WHERE target = 'P') AND b.v IN (SELECT v FROM fd)),
    d5 AS MATERIALIZED (SELECT v, w, d FROM (SELECT *, rank() OVER (PARTITION BY v ORDER BY d) AS r FROM dv) WHERE r <= 5),
    nv AS MATERIALIZED (SELECT v, graph_id AS donor_graph, u FROM (SELECT d5.v, fd.graph_id, vu.u, row_number() OVER (PARTITION BY d5.v ORDER BY d, fd.graph_id) AS r FROM d5 JOIN fd ON fd.v = d5.w JOIN vu ON vu.v = d5.w) WHERE r <= 5),
    nr AS MATERIALIZED (SELECT gw.graph_id, donor_graph, u FROM gw JOIN nv USING (v) WHERE target = 'P'),
    mn AS MATERIALIZED (SELECT graph_id, list(m ORDER BY i) AS mean FROM (SELECT graph_id, i, sum(u[i]) / count(*) AS m FROM nr, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
    ky AS MATERIALIZED (SELECT p.graph_id, p.inode, p.assoc_hash, count(c.elabel) AS k, coalesce(string_agg(c.elabel, ';' ORDER BY c.elabel), '') AS cut_key, a.b6 AS e1, b.b6 AS e2 FROM pt p LEFT JOIN ct c ON c.graph_id = p.graph_id AND c.inode = p.inode JOIN lb a ON a.label = p.lu JOIN lb b ON b.label = p.lv GROUP BY p.graph_id, p.inode, p.assoc_hash, a.b6, b.b6),
    cd AS (SELECT s.graph_id, s.inode, d.graph_id AS donor_graph, d.inode AS donor_inode, g.x, mean, list_transform(g.x, lambda v, i: v - (s.e1 = i - 1)::INTEGER - (s.e2 = i - 1)::INTEGER + (d.e1 = i - 1)::INTEGER + (d.e2 = i - 1)::INTEGER) AS y
           FROM nr JOIN ky d ON d.graph_id = nr.donor_graph JOIN ky s ON s.graph_id = nr.graph_id AND s.cut_key = d.cut_key AND s.k = d.k AND s.assoc_hash <> d.assoc_hash JOIN gu g ON g.graph_id = s.graph_id JOIN mn ON mn.graph_id = s.graph_id),
    rp AS MATERIALIZED (SELECT DISTINCT ON (graph_id) graph_id, inode, donor_graph, donor_inode, {_COSINE.format(x="x")} AS before, {_COSINE.format(x="y")} AS after FROM cd ORDER BY graph_id, after DESC, inode, donor_graph, donor_inode)"""

ORACLE_SQL |= {
    "p_repair_choice": _sql("pt ct tg", _REPAIR + " SELECT graph_id, inode, donor_graph, donor_inode, round(before, 6) AS before, round(after, 6) AS after FROM rp"),
    "k_cut_variants": _recursive("ix b2 mb", f"""lb AS MATERIALIZED ({_LABELS}), mc AS MATERIALIZED (SELECT graph_id, inode, node_id FROM mb),
        ar AS (SELECT DISTINCT m.graph_id, m.inode, b.node_id FROM mc m JOIN b2 b ON b.graph_id = m.graph_id AND b.root = m.node_id), ou AS (SELECT * FROM ar EXCEPT SELECT graph_id, inode, node_id FROM mc),
        sd AS MATERIALIZED (SELECT graph_id, inode, b3 AS b FROM ou JOIN nd USING (graph_id, node_id) JOIN lb USING (label) UNION ALL SELECT graph_id, inode, 8 + b3 FROM mc JOIN nd USING (graph_id, node_id) JOIN lb USING (label)),
        cx AS MATERIALIZED (SELECT graph_id, inode, list_transform(range(16), lambda i: len(list_filter(bs, lambda b: b = i))::DOUBLE) AS x FROM (SELECT graph_id, inode, list(b) AS bs FROM sd GROUP BY 1, 2)),
        en AS MATERIALIZED (SELECT cut_key, assoc_hash, edge_map_sig, x, min(graph_id * 1000 + inode) AS f, count(*) AS n FROM ix JOIN cx USING (graph_id, inode) GROUP BY 1, 2, 3, 4),
        od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cut_key, assoc_hash, edge_map_sig ORDER BY f) AS r, sum(n) OVER (PARTITION BY cut_key, assoc_hash, edge_map_sig) AS freq FROM en),
        gr AS (SELECT cut_key, assoc_hash, edge_map_sig, freq, r, [x] AS kept, true AS took, x FROM od WHERE r = 1 UNION ALL
               SELECT cut_key, assoc_hash, edge_map_sig, freq, r, CASE WHEN far THEN list_append(kept, x) ELSE kept END, far, x FROM (SELECT g.cut_key, g.assoc_hash, g.edge_map_sig, g.freq, o.r, g.kept, o.x, len(list_filter(g.kept, lambda y: list_distance(y, o.x) <= 1.5)) = 0 AS far
               FROM gr g JOIN od o ON o.cut_key = g.cut_key AND o.assoc_hash = g.assoc_hash AND o.edge_map_sig = g.edge_map_sig AND o.r = g.r + 1))""",
        "SELECT cut_key, assoc_hash, edge_map_sig, freq::BIGINT AS freq, (row_number() OVER (PARTITION BY cut_key, assoc_hash, edge_map_sig ORDER BY r))::INTEGER AS variant, array_to_string(list_transform(x, lambda v: v::INTEGER::VARCHAR), ',') AS context FROM gr WHERE took"),
}
