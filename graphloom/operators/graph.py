"""Queries over the property graph. All return lazy DataFrames; every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph, clamp
from graphloom.plans.paths import expand, keyed_edges, reachable, seeds_named
from graphloom.scratch import written

# Edge types that each kind of walk follows.
NEIGHBOUR_TYPES = (
    "CALLS", "IMPORTS", "EXPORTS", "USES", "EXPOSES", "CONTAINS", "DEPENDS_ON", "READS_CONFIG", "IMPLEMENTS",
    "TESTS", "DEFINES", "OWNS", "HAS", "DOCUMENTED_BY", "PRODUCES", "CONSUMES", "QUERIES",
)
FLOW_TYPES = ("EXPOSES", "CALLS", "CALLS_API", "USES", "DEFINES", "OWNS", "PRODUCES", "CONSUMES")
IMPACT_TYPES = {"Column": ("QUERIES", "OWNS"), "Function": ("CALLS",), "Table": ("OWNS", "QUERIES", "ALTERS"), "API": ("CALLS_API", "EXPOSES")}

# Rows up to which a caller's or an API's other ends are handled as one list; ids in a block of services.
LIST, BLOCK = 1_000, 1_000


def has(c: Column, needle: str) -> Column:
    """Case-folded CONTAINS; wildcards in the needle are ordinary characters."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def names_of(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.col("id").alias("node"), F.col("label").alias("node_label"), F.col("name").alias("node_name"))


def search_nodes(graph: Graph, query: str, labels: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """Nodes whose name or id contains the query: score 4 same name, 3 prefix, 2 in the name, 1 in the id only."""
    q, name = query.lower(), F.lower("name")
    score = F.when(name == q, 4).when(name.startswith(q), 3).when(F.contains(name, F.lit(q)), 2).otherwise(1)
    rows = (graph.of(*labels) if labels else graph.nodes).where(has(F.col("name"), q) | has(F.col("id"), q))
    return rows.select("id", "label", "name", score.alias("score")).orderBy(F.desc("score"), "name", "id").limit(clamp(limit, 1, 100))


def list_label(graph: Graph, label: str) -> DataFrame:
    return graph.of(label).select("id", "name").orderBy("name", "id")


def api_map(graph: Graph, service: str | None = None) -> DataFrame:
    """APIs with their paths; of one service only those that it exposes."""
    apis = graph.of("API").select("id", "name", "path")
    if service is not None:
        own = graph.between("EXPOSES").join(seeds_named(graph, service, "Service").withColumnRenamed("seed", "src"), "src", "left_semi")
        apis = apis.join(own.select(F.col("dst").alias("id")), "id")
    return apis.orderBy("path", "id")


def get_dependencies(graph: Graph, service: str, depth: int = 2, exclude_labels: tuple[str, ...] = (), exclude_npm: bool = False) -> DataFrame:
    """Outgoing paths of a service: one row per relationship of every path, with the path's end and depth."""
    allowed = None
    if exclude_labels or exclude_npm:
        allowed = graph.nodes.where(~F.col("label").isin(*exclude_labels)) if exclude_labels else graph.nodes
        if exclude_npm:
            allowed = allowed.where(~((F.col("label") == "Module") & F.col("id").startswith("npm:")))
    paths = expand(seeds_named(graph, service, "Service"), graph.edges, clamp(depth, 1, 10), allowed=allowed)
    hops = paths.select("node", "depth", F.explode(F.arrays_zip("types", "confidences")).alias("r"))
    return hops.join(names_of(graph), "node").select(
        F.lit(service).alias("service"), F.col("node").alias("depends_on"), F.col("r.types").alias("rel_type"), F.col("r.confidences").alias("confidence"), "depth"
    )


def analyze_impact(graph: Graph, name: str, depth: int = 3, only_services: bool = False) -> DataFrame:
    """What reaches any node of this name: affected node, its label, the path to the target, depth."""
    paths = expand(seeds_named(graph, name), graph.edges, clamp(depth, 1, 10), "in")
    ends = graph.nodes.where("label = 'Service'") if only_services else graph.nodes
    return paths.join(ends.select(F.col("id").alias("node"), "label"), "node").select(
        F.col("node").alias("affected"), "label", F.array_join(F.reverse("nodes"), " > ").alias("path"), "depth"
    )


def service_summary(graph: Graph, service: str) -> DataFrame:
    """(section, id, name): exposed APIs, used databases, services called and calling."""
    me = seeds_named(graph, service, "Service")
    out = keyed_edges(graph.edges).join(me, F.col("a") == F.col("seed"), "left_semi").join(names_of(graph), F.col("b") == F.col("node"))
    into = keyed_edges(graph.edges, "in").join(me, F.col("a") == F.col("seed"), "left_semi").join(names_of(graph), F.col("b") == F.col("node"))
    section = (
        F.when((F.col("type") == "EXPOSES") & (F.col("node_label") == "API"), "exposes")
        .when((F.col("type") == "USES") & (F.col("node_label") == "Database"), "uses")
        .when(F.col("type").isin("CALLS", "DEPENDS_ON"), "calls")
    )
    called = F.when(F.col("type").isin("CALLS", "DEPENDS_ON"), "called_by")
    rows = out.select(section.alias("section"), "node", "node_name").unionByName(into.select(called.alias("section"), "node", "node_name"))
    return rows.where("section is not null").select("section", F.col("node").alias("id"), F.col("node_name").alias("name"))


def typed_impact(graph: Graph, label: str, node_id: str, depth: int = 4, cap: int = 200) -> DataFrame:
    """Distinct (id, label, name, distance) reached against the edges that matter for the label.

    A column counts from its table, one hop farther. At most cap * depth rows, nearest first.
    """
    depth = clamp(depth, 1, 4)
    seeds = graph.of(label).where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    extra = 0
    if label == "Column":
        seeds, extra = graph.between("HAS").join(seeds, F.col("dst") == F.col("seed"), "left_semi").select(F.col("src").alias("seed")).distinct(), 1
    paths = expand(seeds, graph.between(*IMPACT_TYPES[label]), depth, "in")
    rows = paths.select("node", (F.col("depth") + extra).alias("distance")).distinct().join(names_of(graph), "node")
    return rows.select(F.col("node").alias("id"), F.col("node_label").alias("label"), F.col("node_name").alias("name"), "distance").orderBy("distance", "name", "id").limit(cap * depth)


def impact_by(rows: DataFrame, column: str) -> DataFrame:
    """Counts of impact rows per service or repository, largest first."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def flow_paths(graph: Graph, seed_id: str, max_hops: int = 8, limit: int = 200, types: tuple[str, ...] = FLOW_TYPES) -> DataFrame:
    """The `limit` shortest undirected paths from a seed over flow edges: depth, path, types."""
    seeds = graph.nodes.where(F.col("id") == seed_id).select(F.col("id").alias("seed"))
    paths = expand(seeds, graph.between(*types), clamp(max_hops, 1, 10), "both", stop_at=limit)
    rows = paths.select("depth", F.array_join("nodes", " > ").alias("path"), F.array_join("types", " > ").alias("types"))
    return rows.orderBy("depth", "path", "types").limit(limit)


def flow_nodes(paths: DataFrame) -> DataFrame:
    """Distinct nodes of flow paths, with the shortest depth at which each stands."""
    return paths.select(F.posexplode(F.split("path", " > ")).alias("pos", "id")).groupBy("id").agg(F.min("pos").alias("first_pos"))


def mermaid(messages: list[tuple[str, str, str]], max_actors: int = 30, max_messages: int = 80) -> str:
    """A sequence diagram of (from, to, label) messages; names are cut and stripped of markup."""
    clean = lambda s, n: "".join(c if c.isalnum() or c in " _-./:" else " " for c in s).strip()[:n] or "unknown"
    actors: dict[str, str] = {}
    lines = []
    for a, b, text in messages:
        for x in (a, b):
            if x not in actors and len(actors) < max_actors:
                actors[x] = f"a{len(actors)}"
        if a in actors and b in actors and len(lines) < max_messages:
            lines.append(f"  {actors[a]}->>{actors[b]}: {clean(text, 120)}")
    head = [f"  participant {alias} as {clean(x, 40)}" for x, alias in actors.items()]
    note = [f"  Note over a0: {len(messages) - len(lines)} messages left out"] if len(lines) < len(messages) else []
    return "\n".join(["sequenceDiagram", *head, *lines, *note])


def neighbours(graph: Graph, seeds: DataFrame, cap: int = 5, types: tuple[str, ...] = NEIGHBOUR_TYPES) -> DataFrame:
    """For every `seeds(seed)`: distinct neighbours, at most `cap` per direction and in all."""
    edges = graph.between(*types)
    out = seeds.join(edges, F.col("seed") == F.col("src")).select("seed", F.lit("out").alias("direction"), F.col("type").alias("edge"), F.col("dst").alias("node"))
    into = seeds.join(edges, F.col("seed") == F.col("dst")).select("seed", F.lit("in").alias("direction"), F.col("type").alias("edge"), F.col("src").alias("node"))
    both = out.unionByName(into).distinct()
    each = Window.partitionBy("seed", "direction").orderBy("edge", "node")
    whole = Window.partitionBy("seed").orderBy("direction", "edge", "node")
    kept = both.withColumn("r", F.row_number().over(each)).where(F.col("r") <= cap).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= cap)
    return kept.join(names_of(graph), "node").select("seed", "direction", "edge", F.col("node").alias("id"), F.col("node_label").alias("label"), F.col("node_name").alias("name"))


def _names(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set("node_name")), ",").alias(name))


def topology(graph: Graph, services: DataFrame, hops: int = 3, types: tuple[str, ...] = ("DEPENDS_ON", "USES", "CALLS"), ends: str = "Service") -> DataFrame:
    """Per service of `services(seed)`: names of `ends` nodes within `hops` downstream and upstream."""
    edges, names = graph.between(*types), names_of(graph).where(F.col("node_label") == ends)
    down = _names(reachable(services, edges, hops).join(names, "node"), "downstream")
    up = _names(reachable(services, edges, hops, "in").join(names, "node"), "upstream")
    return services.join(down, "seed", "left").join(up, "seed", "left").select("seed", F.coalesce("downstream", F.lit("")).alias("downstream"), F.coalesce("upstream", F.lit("")).alias("upstream"))


def ownership(graph: Graph, seeds: DataFrame, types: tuple[str, ...] = ("OWNS", "MAINTAINS")) -> DataFrame:
    """Per seed: names of the nodes that own it; a seed without owners has an empty list."""
    owners = graph.between(*types).join(seeds, F.col("dst") == F.col("seed")).join(names_of(graph), F.col("src") == F.col("node"))
    return seeds.join(_names(owners, "owners"), "seed", "left").select("seed", F.coalesce("owners", F.lit("")).alias("owners"))


def topic_use(graph: Graph, services: DataFrame) -> DataFrame:
    """Per service: names of the topics that it produces and consumes."""
    topics = names_of(graph).where(F.col("node_label").isin("Topic", "MessageQueue"))
    part = lambda kind, name: _names(graph.between(kind).join(services, F.col("src") == F.col("seed")).join(topics, F.col("dst") == F.col("node")), name)
    made, read = part("PRODUCES", "produces"), part("CONSUMES", "consumes")
    return services.join(made, "seed", "left").join(read, "seed", "left").select("seed", F.coalesce("produces", F.lit("")).alias("produces"), F.coalesce("consumes", F.lit("")).alias("consumes"))


def config_of(graph: Graph, service: str, key_part: str, types: tuple[str, ...] = ("READS_CONFIG", "USES_SECRET")) -> DataFrame:
    """Config keys and secrets of a service and others whose name contains `key_part`: one row per node."""
    own = graph.between(*types).join(seeds_named(graph, service, "Service"), F.col("src") == F.col("seed")).select(F.col("dst").alias("id"))
    keys = graph.of("ConfigKey", "SecretRef", "Config")
    return keys.join(own, "id", "left_semi").unionByName(keys.where(has(F.col("name"), key_part))).select("id", "label", "name").distinct()


def commits_of(graph: Graph, files: DataFrame, limit: int = 20) -> DataFrame:
    """Newest commits that touched `files(id)`, each with its files; commits carry `authored_at`."""
    touched = graph.between("TOUCHED").join(files.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return (
        touched.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("files"))
        .join(graph.of("Commit").select(F.col("id").alias("src"), "name", "authored_at"), "src")
        .select(F.col("src").alias("commit"), "name", "authored_at", "files").orderBy(F.desc("authored_at"), "commit").limit(limit)
    )


def find_with(graph: Graph, label: str, needle: str, edge: str, incoming: bool, limit: int = 25) -> DataFrame:
    """Nodes whose name contains the needle, with the ids on the other side of `edge` (may be none)."""
    found = graph.of(label).where(has(F.col("name"), needle)).select("id", "name").orderBy("name", "id").limit(limit)
    e = graph.between(edge).select(F.col("dst" if incoming else "src").alias("id"), F.col("src" if incoming else "dst").alias("other"))
    return found.join(e, "id", "left").groupBy("id", "name").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))


def seed_nodes(graph: Graph, label: str, needle: str, limit: int = 25) -> DataFrame:
    """Start nodes of a label: name or path contains the needle."""
    return graph.of(label).where(has(F.col("name"), needle) | has(F.coalesce("path", F.lit("")), needle)).orderBy("name", "id").limit(limit)


def multi_hop(graph: Graph, label: str, needle: str, types: tuple[str, ...] = ("CALLS", "EXPOSES", "USES", "CALLS_API"), hops: int = 2, most: int = 25) -> DataFrame:
    """Per seed: the first `most` names reached within `hops` over the given types."""
    seeds = seed_nodes(graph, label, needle).select(F.col("id").alias("seed"))
    ends = reachable(seeds, graph.between(*types), hops).join(names_of(graph), "node")
    return ends.groupBy("seed").agg(F.array_join(F.slice(F.array_sort(F.collect_set("node_name")), 1, most), ",").alias("terminals"))


def declared_dependencies(graph: Graph, service: str) -> DataFrame:
    """Distinct (name, label) one hop from a service."""
    edges = graph.between("CALLS", "DEPENDS_ON", "USES", "CALLS_API", "EXPOSES").join(seeds_named(graph, service, "Service"), F.col("src") == F.col("seed"))
    return edges.join(names_of(graph), F.col("dst") == F.col("node")).select(F.col("node_name").alias("name"), F.col("node_label").alias("label")).distinct()


def api_candidates(graph: Graph, limit: int | None = None) -> DataFrame:
    """APIs with each service that exposes them; unexposed ones once, without a service."""
    owner = graph.between("EXPOSES").select(F.col("src").alias("service_id"), F.col("dst").alias("id"))
    rows = graph.of("API").select("id", "name", "path").join(owner, "id", "left").select("id", "name", "path", "service_id")
    return rows.orderBy("id", "service_id").limit(limit) if limit else rows


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(from_id, t), right(to_id, t): (from_id, to_id, n) with n the number of row pairs of equal t.

    The ends of each t travel as one list to its callers, whose lists are counted one caller at a
    time: pairs appear in the result only, never in a shuffle. Callers with more than LIST rows, or
    with a t of more than LIST ends, would make lists too long; their pairs are grouped one by one.
    """
    over = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST).select(key)
    wide = written(over(right, "t"), "wide")
    large = over(left, "from_id")
    if not wide.isEmpty():
        large = large.unionByName(left.join(wide, "t", "left_semi").select("from_id")).distinct()
    large = written(large, "large")
    all_few = large.isEmpty()
    few = left if all_few else left.join(large, "from_id", "left_anti")
    narrow = right if wide.isEmpty() else right.join(wide, "t", "left_anti")
    own = few.join(narrow.groupBy("t").agg(F.collect_list("to_id").alias("ends")), "t")
    own = own.select("from_id", "ends").repartition("from_id").groupBy("from_id").agg(F.sort_array(F.flatten(F.collect_list("ends"))).alias("ends"))
    first = F.filter(F.sequence(F.lit(1), F.size("ends")), lambda i: (i == 1) | (F.get("ends", i - 1) != F.get("ends", i - 2)))
    runs = own.where(F.size("ends") > 0).withColumn("first", first)
    run = F.transform("first", lambda i, k: F.struct(F.get("ends", i - 1).alias("to_id"), (F.coalesce(F.get("first", k + 1), F.size("ends") + 1) - i).cast("long").alias("n")))
    counts = runs.select("from_id", F.explode(run).alias("e")).select("from_id", "e.to_id", "e.n")
    if all_few:
        return counts
    return counts.unionByName(left.join(large, "from_id", "left_semi").join(right, "t").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n")))


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(from_id, t), right(to_id, t), rows distinct: (from_id, to_id, n) with n the number of t in common.

    Services of equal topic sets form a class, told by a digest of the set; topics are counted
    between classes. Members of two classes meet as blocks of about BLOCK ids on either side, each
    pair of blocks in a task of its own; only the result names pairs of services.
    """

    def classes(rows: DataFrame, who: str, name: str) -> tuple[DataFrame, DataFrame]:
        own = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "t")).alias("y"))
        members = written(rows.groupBy(who).agg(own.alias(name)), "classes")
        return members, written(members.groupBy(name).agg(F.min(who).alias(who)).join(rows, who).select(name, "t"), "topics")

    def blocks(rows: DataFrame, who: str, what: Column, number: str, count: str) -> DataFrame:
        sizes = rows.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(count))
        dealt = rows.join(sizes, "p").withColumn(number, F.pmod(F.xxhash64(who), F.col(count)))
        return dealt.groupBy("p", number, count).agg(F.collect_list(what).alias(who))

    (makers, made), (users, used) = classes(left, "from_id", "p"), classes(right, "to_id", "q")
    counts = _counted(used.select(F.col("q").alias("from_id"), "t"), made.select(F.col("p").alias("to_id"), "t"))
    counts = written(counts.select(F.col("from_id").alias("q"), F.col("to_id").alias("p"), "n").join(users, "q").select("p", "to_id", "n"), "shared")
    a, b = blocks(makers, "from_id", F.col("from_id"), "i", "of_i"), blocks(counts, "to_id", F.struct("to_id", "n"), "j", "of_j")
    # every block of one side goes to each block of the other
    ways = a.groupBy("p").agg(F.max("of_i").alias("of_i")).join(b.groupBy("p").agg(F.max("of_j").alias("of_j")), "p")
    each = lambda rows, who, number, other, count: rows.select("p", who, number).join(ways.select("p", count), "p").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).drop(count)
    met = each(a, "from_id", "i", "j", "of_j").join(each(b, "to_id", "j", "i", "of_i"), ["p", "i", "j"])
    pairs = met.select("from_id", F.explode("to_id").alias("e")).select(F.explode("from_id").alias("from_id"), "e")
    return pairs.select("from_id", "e.to_id", "e.n")


def service_edges(graph: Graph) -> DataFrame:
    """(from_id, to_id, kind, n) between services, self edges dropped, n: how often the pattern holds.

    CALLS_API: calls of an exposed API. PRODUCES, and CONSUMES the other way: shared topics.
    SHARED_TABLE: the owner of a table, and a service whose files define functions that query it.
    """
    e = lambda kind, a, b: graph.between(kind).select(F.col("src").alias(a), F.col("dst").alias(b))
    called = _counted(e("CALLS_API", "from_id", "t"), e("EXPOSES", "to_id", "t")).select("from_id", "to_id", F.lit("CALLS_API").alias("kind"), "n")
    tables = e("OWNS", "from_id", "t").join(graph.of("Table").select(F.col("id").alias("t")), "t", "left_semi").join(e("QUERIES", "f", "t"), "t")
    tables = tables.join(e("DEFINES", "file", "f"), "f").join(e("CONTAINS", "to_id", "file"), "file").select("from_id", "to_id", F.lit("SHARED_TABLE").alias("kind"))
    tables = tables.groupBy("from_id", "to_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    topics = _shared(e("PRODUCES", "from_id", "t").distinct(), e("CONSUMES", "to_id", "t").distinct())
    way = lambda a, b, kind: F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("kind"), "n")
    topics = topics.select(F.inline(F.array(way("from_id", "to_id", "PRODUCES"), way("to_id", "from_id", "CONSUMES"))))
    return called.unionByName(tables).unionByName(topics).where("from_id <> to_id")


def edge_kinds(rows: DataFrame) -> DataFrame:
    """(from_id, to_id, kinds): the multiset of kinds of each pair as `kind=n,...`, kinds in order."""
    counts = rows.groupBy("from_id", "to_id", "kind").agg(F.sum("n").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda s: F.concat_ws("=", s["kind"], s["n"].cast("string"))), ",")
    return counts.groupBy("from_id", "to_id").agg(line.alias("kinds"))


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots of (from_id, to_id, kinds): added, removed and changed edges."""
    both = old.withColumnRenamed("kinds", "old_kinds").join(new.withColumnRenamed("kinds", "new_kinds"), ["from_id", "to_id"], "full_outer")
    change = F.when(F.col("old_kinds").isNull(), "added").when(F.col("new_kinds").isNull(), "removed").when(F.col("old_kinds") != F.col("new_kinds"), "changed")
    return both.withColumn("change", change).where("change is not null").select("change", "from_id", "to_id", "old_kinds", "new_kinds")


def compare_sets(declared: DataFrame, runtime: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two frames as overlap, declared_only or runtime_only."""
    a, b = declared.select(key).distinct().withColumn("a", F.lit(1)), runtime.select(key).distinct().withColumn("b", F.lit(1))
    kind = F.when(F.col("a").isNull(), "runtime_only").when(F.col("b").isNull(), "declared_only").otherwise("overlap")
    return a.join(b, key, "full_outer").select(key, kind.alias("side"))


def label_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def schema_drift(old_nodes: DataFrame, graph: Graph) -> DataFrame:
    """New Migration, Table and Column ids, each with the services that own or alter it."""
    new = graph.of("Migration", "Table", "Column").join(old_nodes.select("id"), "id", "left_anti").select("id", "label")
    owners = graph.between("OWNS", "ALTERS").select(F.col("dst").alias("id"), F.col("src").alias("owner"))
    return new.join(owners, "id", "left")
