"""Graph queries over the star schema's projection, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import graph as g
from graphloom.plans.projection import STAR_SQL, star_graph, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOMER, SUPPLIER = "Customer#000000085", "Supplier#000000001"


def _sql(body: str, topics: bool = False, more: str = "") -> str:
    star = STAR_SQL.replace("nodes(id", "all_nodes(id").replace("edges(src", "all_edges(src")
    nodes = "" if topics else " WHERE label <> 'Topic'"
    edges = "" if topics else " WHERE type NOT IN ('PRODUCES', 'CONSUMES')"
    return f"WITH RECURSIVE {star}, nodes AS (SELECT * FROM all_nodes{nodes}), edges AS (SELECT * FROM all_edges{edges}){more} {body}"


def _walk(seed: str, hops: int, types: str = "", direction: str = "out") -> str:
    """CTEs e and walk: all paths of up to `hops` edges from `SELECT ... AS seed`."""
    only = f"WHERE type IN ({types})" if types else ""
    key = "type || '|' || src || '|' || dst"
    out = f"SELECT src AS a, dst AS b, {key} AS edge, type, coalesce(confidence, 'HIGH') AS conf FROM edges {only}"
    back = f"SELECT dst AS a, src AS b, {key} AS edge, type, coalesce(confidence, 'HIGH') AS conf FROM edges {only}"
    e = {"out": out, "in": back, "both": f"{out} UNION ALL {back}"}[direction]
    return f""", e AS ({e}), walk AS (
      SELECT seed, seed AS node, 0 AS depth, [seed] AS ns, CAST([] AS VARCHAR[]) AS es, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS cs FROM ({seed})
      UNION ALL SELECT w.seed, e.b, w.depth + 1, list_append(w.ns, e.b), list_append(w.es, e.edge), list_append(w.ts, e.type), list_append(w.cs, e.conf)
      FROM walk w JOIN e ON w.node = e.a WHERE w.depth < {hops} AND NOT list_contains(w.es, e.edge))"""


def _seed(name: str, label: str = "Service") -> str:
    return f"SELECT id AS seed FROM nodes WHERE name = '{name}' AND label = '{label}'"


def query(name: str, sql: str | None, topics: bool = False):
    """Register f(graph) as a query over the star graph."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(star_graph(spark, sf_dir, topics))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("g01_search_nodes", _sql("""SELECT id, label, name, CASE WHEN lower(name) = 'nation_1' THEN 4 WHEN starts_with(lower(name), 'nation_1') THEN 3
  WHEN contains(lower(name), 'nation_1') THEN 2 ELSE 1 END AS score FROM nodes WHERE contains(lower(name), 'nation_1') OR contains(lower(id), 'nation_1')
  ORDER BY score DESC, name, id LIMIT 20"""))  # fmt: skip
def _(graph: Graph):
    return g.search_nodes(graph, "NATION_1")


@query("g01b_search_label", _sql("""SELECT id, label, name, CASE WHEN lower(name) = 'ring' THEN 4 WHEN starts_with(lower(name), 'ring') THEN 3
  WHEN contains(lower(name), 'ring') THEN 2 ELSE 1 END AS score FROM nodes WHERE label IN ('API', 'Database') AND (contains(lower(name), 'ring') OR contains(lower(id), 'ring'))
  ORDER BY score DESC, name, id LIMIT 50"""))  # fmt: skip
def _(graph: Graph):
    return g.search_nodes(graph, "ring", ("API", "Database"), 50)


for _name, _label in (("g02_list_services", "Service"), ("g02b_list_databases", "Database"), ("s13_label_scan", "Team")):
    query(_name, _sql(f"SELECT id, name FROM nodes WHERE label = '{_label}'"))(lambda graph, label=_label: g.list_label(graph, label))

query("g03_api_map", _sql("SELECT id, name, path FROM nodes WHERE label = 'API'"))(g.api_map)
query("g03b_api_map_of_service", _sql(f"""SELECT n.id, n.name, n.path FROM nodes n JOIN edges e ON e.dst = n.id AND e.type = 'EXPOSES'
  JOIN nodes s ON s.id = e.src WHERE s.name = '{SUPPLIER}' AND n.label = 'API'"""))(lambda graph: g.api_map(graph, SUPPLIER))  # fmt: skip

_DEPENDENCIES = """SELECT '{name}' AS service, node AS depends_on, unnest(ts) AS rel_type, unnest(cs) AS confidence, depth FROM walk WHERE depth > 0"""
query("g04_get_dependencies", _sql(_DEPENDENCIES.format(name=CUSTOMER), more=_walk(_seed(CUSTOMER), 3)))(lambda graph: g.get_dependencies(graph, CUSTOMER, 3))
query("g04b_dependencies_excluding", _sql("""SELECT 'Supplier#000000001' AS service, node AS depends_on, unnest(ts) AS rel_type, unnest(cs) AS confidence, depth FROM walk WHERE depth > 0
  AND NOT list_has_any(ns, (SELECT list(id) FROM nodes WHERE label = 'Database'))""", more=_walk(_seed(SUPPLIER), 2)))(
    lambda graph: g.get_dependencies(graph, SUPPLIER, 2, exclude_labels=("Database",), exclude_npm=True)
)

_PART_NAME = "red widget"
query("g05_analyze_impact", _sql("SELECT node AS affected, n.label, array_to_string(list_reverse(ns), ' > ') AS path, depth FROM walk JOIN nodes n ON n.id = node WHERE depth > 0", more=_walk("SELECT id AS seed FROM nodes WHERE name = '17'", 3, direction="in")))(
    lambda graph: g.analyze_impact(graph, "17", 3)
)
query("g05b_impact_only_services", _sql("SELECT node AS affected, n.label, array_to_string(list_reverse(ns), ' > ') AS path, depth FROM walk JOIN nodes n ON n.id = node WHERE depth > 0 AND n.label = 'Service'", more=_walk("SELECT id AS seed FROM nodes WHERE name = '17'", 3, direction="in")))(
    lambda graph: g.analyze_impact(graph, "17", 3, only_services=True)
)
query("g06_service_summary", _sql(f"""SELECT CASE WHEN e.type = 'EXPOSES' THEN 'exposes' WHEN e.type = 'USES' THEN 'uses' ELSE 'calls' END AS section, n.id, n.name
  FROM edges e JOIN ({_seed(SUPPLIER)}) s ON e.src = s.seed JOIN nodes n ON n.id = e.dst WHERE (e.type = 'EXPOSES' AND n.label = 'API') OR (e.type = 'USES' AND n.label = 'Database') OR e.type IN ('CALLS', 'DEPENDS_ON')
  UNION ALL SELECT 'called_by', n.id, n.name FROM edges e JOIN ({_seed(SUPPLIER)}) s ON e.dst = s.seed JOIN nodes n ON n.id = e.src WHERE e.type IN ('CALLS', 'DEPENDS_ON')"""))(
    lambda graph: g.service_summary(graph, SUPPLIER)
)
query("g07_typed_impact", _sql("SELECT id, label, name, distance FROM (SELECT DISTINCT node AS id, n.label, n.name, depth AS distance FROM walk JOIN nodes n ON n.id = node WHERE depth > 0) ORDER BY distance, name, id LIMIT 800", more=_walk("SELECT 'part:1' AS seed", 4, "'CALLS_API', 'EXPOSES'", "in")))(
    lambda graph: g.typed_impact(graph, "API", "part:1")
)


def _impact_by_nation(graph: Graph):
    rows = g.typed_impact(graph, "API", "part:1")
    owner = graph.between("OWNS").select(F.col("dst").alias("id"), F.col("src").alias("nation"))
    return g.impact_by(rows.join(owner, "id", "left"), "nation")


query("a06_impact_by_owner", _sql("SELECT o.src AS key, count(*) AS n FROM (SELECT DISTINCT node AS id, depth FROM walk WHERE depth > 0) w JOIN edges o ON o.dst = w.id AND o.type = 'OWNS' GROUP BY 1", more=_walk("SELECT 'part:1' AS seed", 4, "'CALLS_API', 'EXPOSES'", "in")))(_impact_by_nation)
query("g08_synthesize_flow", _sql("SELECT depth, array_to_string(ns, ' > ') AS path, array_to_string(ts, ' > ') AS types FROM walk WHERE depth > 0 ORDER BY depth, path, types LIMIT 200", more=_walk("SELECT 'customer:1' AS seed", 3, "'EXPOSES', 'CALLS', 'CALLS_API'", "both")))(
    lambda graph: g.flow_paths(graph, "customer:1", 3, types=("EXPOSES", "CALLS", "CALLS_API"))
)
query("g08b_flow_nodes", _sql("SELECT n AS id, min(pos) - 1 AS first_pos FROM (SELECT unnest(ns) AS n, unnest(range(1, len(ns) + 1)) AS pos FROM (SELECT ns, depth, array_to_string(ns, ' > ') AS path, array_to_string(ts, ' > ') AS types FROM walk WHERE depth > 0 ORDER BY depth, path, types LIMIT 200)) GROUP BY 1", more=_walk("SELECT 'customer:1' AS seed", 3, "'EXPOSES', 'CALLS', 'CALLS_API'", "both")))(
    lambda graph: g.flow_nodes(g.flow_paths(graph, "customer:1", 3, types=("EXPOSES", "CALLS", "CALLS_API")))
)


def _seeds(graph: Graph, prefix: str):
    return graph.nodes.where(F.col("id").startswith(prefix)).select(F.col("id").alias("seed"))


query("g10_neighbours", _sql("""SELECT seed, direction, edge, id, label, name FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY direction, edge, node) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, direction ORDER BY edge, node) AS r FROM (
  SELECT src AS seed, 'out' AS direction, type AS edge, dst AS node FROM edges WHERE starts_with(src, 'supplier:') UNION SELECT dst, 'in', type, src FROM edges WHERE starts_with(dst, 'supplier:'))) WHERE r <= 5)
  JOIN nodes ON id = node WHERE r2 <= 5"""))(lambda graph: g.neighbours(graph, _seeds(graph, "supplier:")))  # fmt: skip
query("g11_topology", _sql("""SELECT n.id AS seed, coalesce(d.x, '') AS downstream, coalesce(u.x, '') AS upstream FROM (SELECT id FROM nodes WHERE label = 'Team') n
  LEFT JOIN (SELECT seed, array_to_string(list_sort(list(DISTINCT name)), ',') AS x FROM walk JOIN nodes ON id = node WHERE depth > 0 AND label = 'Service' GROUP BY 1) d ON d.seed = n.id
  LEFT JOIN (SELECT NULL AS seed, NULL AS x) u ON u.seed = n.id""", more=_walk("SELECT id AS seed FROM nodes WHERE label = 'Team'", 1, "'OWNS', 'CALLS'")))(
    lambda graph: g.topology(graph, _seeds(graph, "nation:"), 1, ("OWNS", "CALLS"))
)
query("g12_ownership", _sql("SELECT s.id AS seed, coalesce(x, '') AS owners FROM (SELECT id FROM nodes WHERE label IN ('Service', 'Team')) s LEFT JOIN (SELECT e.dst, array_to_string(list_sort(list(DISTINCT n.name)), ',') AS x FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type IN ('OWNS', 'MAINTAINS') GROUP BY 1) o ON o.dst = s.id"))(
    lambda graph: g.ownership(graph, graph.of("Service", "Team").select(F.col("id").alias("seed")))
)
_TOPIC = "SELECT e.src, array_to_string(list_sort(list(DISTINCT n.name)), ',') AS x FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = '{}' GROUP BY 1"
query("g14_topic_use", _sql(f"SELECT s.id AS seed, coalesce(p.x, '') AS produces, coalesce(c.x, '') AS consumes FROM (SELECT id FROM nodes WHERE label = 'Service') s LEFT JOIN ({_TOPIC.format('PRODUCES')}) p ON p.src = s.id LEFT JOIN ({_TOPIC.format('CONSUMES')}) c ON c.src = s.id", topics=True), topics=True)(
    lambda graph: g.topic_use(graph, graph.of("Service").select(F.col("id").alias("seed")))
)
query("g16_seed_lookup", _sql("SELECT id, label, name, path FROM nodes WHERE label = 'API' AND (contains(lower(name), 'bolt') OR contains(lower(coalesce(path, '')), 'bolt')) ORDER BY name, id LIMIT 25"))(
    lambda graph: g.seed_nodes(graph, "API", "bolt")
)
query("g17_multi_hop", _sql("""SELECT seed, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 25), ',') AS terminals FROM walk JOIN nodes ON id = node WHERE depth > 0 GROUP BY 1""",
  more=_walk("SELECT id AS seed FROM (SELECT id, name FROM nodes WHERE label = 'Service' AND contains(lower(name), '00001') ORDER BY name, id LIMIT 25)", 2, "'CALLS', 'EXPOSES', 'USES', 'CALLS_API'")))(
    lambda graph: g.multi_hop(graph, "Service", "00001")
)
query("g18_find_function", _sql("SELECT f.id, f.name, coalesce(array_to_string(list_sort(list(e.src)), ','), '') AS others FROM (SELECT id, name FROM nodes WHERE label = 'Function' AND contains(name, '77') ORDER BY name, id LIMIT 25) f LEFT JOIN edges e ON e.dst = f.id AND e.type = 'CALLS' GROUP BY 1, 2"))(
    lambda graph: g.find_with(graph, "Function", "77", "CALLS", incoming=True)
)
query("g18b_find_table", _sql("SELECT f.id, f.name, coalesce(array_to_string(list_sort(list(e.dst)), ','), '') AS others FROM (SELECT id, name FROM nodes WHERE label = 'Repo' AND contains(lower(name), 'a') ORDER BY name, id LIMIT 25) f LEFT JOIN edges e ON e.src = f.id AND e.type = 'CONTAINS' GROUP BY 1, 2"))(
    lambda graph: g.find_with(graph, "Repo", "a", "CONTAINS", incoming=False)
)
query("g19_declared_dependencies", _sql(f"SELECT DISTINCT n.name, n.label FROM edges e JOIN ({_seed(SUPPLIER)}) s ON s.seed = e.src JOIN nodes n ON n.id = e.dst WHERE e.type IN ('CALLS', 'DEPENDS_ON', 'USES', 'CALLS_API', 'EXPOSES')"))(
    lambda graph: g.declared_dependencies(graph, SUPPLIER)
)
query("g20_api_candidates", _sql("SELECT n.id, n.name, n.path, e.src AS service_id FROM nodes n LEFT JOIN edges e ON e.dst = n.id AND e.type = 'EXPOSES' WHERE n.label = 'API'"))(g.api_candidates)
query("g21_service_edges", _sql("""SELECT from_id, to_id, kind, count(*) AS n FROM (
  SELECT p.src AS from_id, c.src AS to_id, 'PRODUCES' AS kind FROM edges p JOIN edges c ON c.dst = p.dst AND c.type = 'CONSUMES' WHERE p.type = 'PRODUCES'
  UNION ALL SELECT c.src, p.src, 'CONSUMES' FROM edges p JOIN edges c ON c.dst = p.dst AND c.type = 'CONSUMES' WHERE p.type = 'PRODUCES'
  UNION ALL SELECT a.src, b.src, 'CALLS_API' FROM edges a JOIN edges b ON b.dst = a.dst AND b.type = 'EXPOSES' WHERE a.type = 'CALLS_API') WHERE from_id <> to_id GROUP BY 1, 2, 3""", topics=True), topics=True)(g.service_edges)  # fmt: skip
query("j06_api_callers", _sql("SELECT a.src AS from_id, b.src AS to_id, 'CALLS_API' AS kind, count(*) AS n FROM edges a JOIN edges b ON b.dst = a.dst AND b.type = 'EXPOSES' WHERE a.type = 'CALLS_API' AND a.src <> b.src GROUP BY 1, 2"))(
    lambda graph: g.service_edges(Graph(graph.nodes, graph.between("CALLS_API", "EXPOSES")))
)
query("a02_label_counts", _sql("SELECT label, count(*) AS n FROM nodes GROUP BY 1"))(g.label_counts)
query("a01_graph_counts", _sql("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges"))(
    lambda graph: graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("n_edges")))  # two single rows
)
query("a08_snapshot_summary", _sql("SELECT (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM nodes WHERE label = 'Service') AS service_count, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM nodes GROUP BY 1)) AS node_counts"))(
    lambda graph: graph.edges.agg(F.count(F.lit(1)).alias("edge_count"))
    .crossJoin(graph.of("Service").agg(F.count(F.lit(1)).alias("service_count")))  # single rows
    .crossJoin(g.label_counts(graph).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("n").cast("string")))), ",").alias("node_counts")))
)


def _snapshots(spark, sf_dir, year):
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year)
    rows = o.select(F.concat(F.lit("customer:"), "o_custkey").alias("from_id"), F.concat(F.lit("priority:"), "o_orderpriority").alias("to_id"), F.col("o_orderstatus").alias("kind"), F.lit(1).cast("long").alias("n"))
    return g.edge_kinds(rows)


_SNAP = "SELECT from_id, to_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT 'customer:' || o_custkey AS from_id, 'priority:' || o_orderpriority AS to_id, o_orderstatus AS kind, count(*) AS n FROM orders WHERE year(o_orderdate) = {} GROUP BY 1, 2, 3) GROUP BY 1, 2"
QUERIES["a07_edge_kinds"] = lambda spark, sf_dir: _snapshots(spark, sf_dir, 1996)
ORACLE_SQL["a07_edge_kinds"] = _SNAP.format(1996)
QUERIES["j16_snapshot_diff"] = lambda spark, sf_dir: g.diff_edges(_snapshots(spark, sf_dir, 1996), _snapshots(spark, sf_dir, 1997))
ORACLE_SQL["j16_snapshot_diff"] = f"""SELECT CASE WHEN o.kinds IS NULL THEN 'added' WHEN n.kinds IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(o.from_id, n.from_id) AS from_id, coalesce(o.to_id, n.to_id) AS to_id,
  o.kinds AS old_kinds, n.kinds AS new_kinds FROM ({_SNAP.format(1996)}) o FULL JOIN ({_SNAP.format(1997)}) n ON o.from_id = n.from_id AND o.to_id = n.to_id WHERE o.kinds IS DISTINCT FROM n.kinds"""
QUERIES["j15_compare_dependencies"] = lambda spark, sf_dir: g.compare_sets(
    table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("pair")),
    table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("pair")), "pair",
)
ORACLE_SQL["j15_compare_dependencies"] = """SELECT coalesce(a.pair, b.pair) AS pair, CASE WHEN a.pair IS NULL THEN 'runtime_only' WHEN b.pair IS NULL THEN 'declared_only' ELSE 'overlap' END AS side
  FROM (SELECT DISTINCT l_suppkey || '-' || l_partkey AS pair FROM lineitem WHERE l_linestatus = 'F') a FULL JOIN (SELECT DISTINCT l_suppkey || '-' || l_partkey AS pair FROM lineitem WHERE l_linestatus = 'O') b ON a.pair = b.pair"""
