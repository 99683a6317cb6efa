"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.session import cut_lineage, free_shuffles, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of each vertex of an undirected graph; a component is named by its least id.

    Large-star and small-star steps in turn, each a union, a grouped minimum and a join; hot
    vertices cost one row per edge and are pre-aggregated by the minimum. Every round is written
    to the shared checkpoint folder. Null endpoints are ignored, self-loops keep their vertex, an
    empty graph gives no rows.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    alone = both.where("u = v").select(F.col("u").alias("id")).distinct()
    now = cut_lineage(both.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        # Large star: each vertex links its larger neighbours to the least of its neighbours and itself.
        near = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each vertex links its smaller neighbours and itself to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        before, now = now, cut_lineage(small.distinct())
        release(before)
        # Settled: as many edges as before, and the same sum of hashes.
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            break
        last = sign
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).unionByName(alone.select("id", F.col("id").alias("component")))
    return out.groupBy("id").agg(F.min("component").alias("component"))


# Which node types become which vertex labels, and the endpoint pairs a relation may join.
LABELS = {"function": "Function", "method": "Function", "class": "Class", "module": "Module", "file": "Module", "external": "External"}
RELATIONS = {"CALLS": "Calls", "CONTAINS": "Contains", "DEFINES": "Defines", "IMPORTS": "Imports"}
ALLOWED = {
    "Imports": [("Module", "Module"), ("Module", "External")],
    "Calls": [(s, t) for s in ("Function", "Class") for t in ("Function", "Class", "External")] + [("Module", t) for t in ("External", "Function", "Class")],
    "Defines": [("Module", "Function"), ("Module", "Class")],
    "Contains": [("Class", "Function"), ("Class", "Class")],
}
UNRESOLVED, UNRESOLVED_FQN = "__unresolved__::", "__unresolved_fqn__::"


def label(kind):
    """The vertex label of a node type in any case; null for types outside the graph."""
    out = F.lit(None).cast("string")
    for name, value in LABELS.items():
        out = F.when(F.lower(kind) == name, value).otherwise(out)
    return out


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with resolved ends: (source_fqn, source_type, target, target_type, type). A target that is no
    node stays as it is, of type EXTERNAL, if it's marked unresolved; others are dropped. nodes: unique ids."""
    n1 = nodes.select(F.col("id").alias("source_id"), F.col("fqn").alias("source_fqn"), F.col("type").alias("source_type"))
    n2 = nodes.select(F.col("id").alias("target_id"), F.col("fqn").alias("_fqn"), F.col("type").alias("_type"))
    joined = edges.select("source_id", "target_id", "type").join(n1, "source_id").join(n2, "target_id", "left")
    kept = joined.where(F.col("_type").isNotNull() | F.col("target_id").startswith("__unresolved"))
    return kept.select("source_fqn", "source_type", F.coalesce("_fqn", "target_id").alias("target"), F.coalesce("_type", F.lit("EXTERNAL")).alias("target_type"), "type")


def typed_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src_label, src, rel, dst_label, dst) whose ends the relation allows."""
    rel = F.create_map(*[F.lit(x) for p in RELATIONS.items() for x in p])
    e = graph_edges(edges, nodes).select(
        label(F.col("source_type")).alias("src_label"), F.col("source_fqn").alias("src"), rel[F.col("type")].alias("rel"), label(F.col("target_type")).alias("dst_label"), F.col("target").alias("dst")
    )
    ok = F.concat_ws(">", "rel", "src_label", "dst_label").isin(*[f"{r}>{s}>{t}" for r, pairs in ALLOWED.items() for s, t in pairs])
    return e.where("rel is not null and src_label is not null and dst_label is not null").where(ok).distinct()


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(callee_id, caller_id, type): edges to a node's id or to its unresolved name; two equi-joins instead of an OR."""
    by_id = edges.join(nodes.select(F.col("id").alias("callee_id")), F.col("target_id") == F.col("callee_id"))
    by_name = edges.join(nodes.select(F.col("id").alias("callee_id"), F.concat(F.lit(UNRESOLVED), F.col("name")).alias("_u")), F.col("target_id") == F.col("_u"))
    columns = ["callee_id", F.col("source_id").alias("caller_id"), "type"]
    return by_id.select(*columns).unionByName(by_name.select(*columns)).distinct()


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller_id, callee_id, type): the nodes an edge's target names, by id or unresolved name."""
    return callers(edges, nodes).select(F.col("caller_id"), "callee_id", "type")


def neighbors(graph: DataFrame, relations: list[str]) -> DataFrame:
    """Distinct (node, neighbor) over the relations, in both directions."""
    e = graph.where(F.col("rel").isin(*relations)).select("src", "dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("neighbor")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"))).distinct()


def resolve_by_path(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, node_id) for targets `a.b.Name` of dotted imports: a Python node whose fqn holds a/b.py::Name;
    of several, the one of the greatest id. Nodes are joined on name and last path segment, so that a name
    every file has is no hot key; the rest is a filter."""
    dotted = F.substr("target_id", F.lit(len(UNRESOLVED_FQN) + 1))
    e = edges.where(F.col("target_id").startswith(UNRESOLVED_FQN)).select(F.col("id").alias("edge_id"), F.split(dotted, r"\.").alias("p"))
    e = e.where(F.size("p") > 1).select("edge_id", F.element_at("p", -1).alias("name"), F.concat(F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/"), F.lit(".py::"), F.element_at("p", -1)).alias("part"))
    segment = lambda c: F.regexp_extract(c, r"([^/]*\.py)::", 1)
    e = e.withColumn("_file", segment(F.col("part")))
    n = nodes.where(F.lower("language") == "python").select("name", "fqn", F.col("id").alias("node_id"), F.explode(F.array_distinct(F.regexp_extract_all("fqn", F.lit(r"([^/]*\.py)::"), F.lit(1)))).alias("_stored"))
    # The name may end where a longer file name does: a/xb.py::N holds b.py::N.
    tail = F.explode(F.transform(F.sequence(F.lit(1), F.length("_stored") - 3), lambda i: F.substr("_stored", i)))
    return e.join(n.withColumn("_file", tail), ["name", "_file"]).where(F.contains("fqn", F.col("part"))).groupBy("edge_id").agg(F.max("node_id").alias("node_id"))


def resolve_by_name(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, node_id) for unresolved names: a node of the source's language first, else of any; of several the greatest id.
    Names are reduced to one node per language before the join, so a common name is no hot key of nodes."""
    e = edges.where(F.col("target_id").startswith(UNRESOLVED)).select(F.col("id").alias("edge_id"), "source_id", F.substr("target_id", F.lit(len(UNRESOLVED) + 1)).alias("name"))
    per_language = nodes.where("name is not null").groupBy("name", "language").agg(F.max("id").alias("same"))
    any_language = per_language.groupBy("name").agg(F.max("same").alias("other"))
    source = nodes.select(F.col("id").alias("source_id"), "language")
    known = e.join(source, "source_id", "left").join(per_language, ["name", "language"], "left").join(any_language, "name", "left")
    return known.select("edge_id", F.coalesce("same", "other").alias("node_id")).where("node_id is not null")


def apply_resolution(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges with resolved targets; where that would repeat (source, target, type), the edge that had it,
    else the least id, takes it and the others keep their old target."""
    joined = edges.join(found.withColumnRenamed("edge_id", "id"), "id", "left").withColumn("_new", F.coalesce("node_id", "target_id"))
    first = F.row_number().over(Window.partitionBy("source_id", "_new", "type").orderBy((F.col("_new") != F.col("target_id")).cast("int"), "id"))
    return joined.withColumn("_n", first).withColumn("target_id", F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.col("target_id"))).drop("_n", "_new", "node_id")


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, hop): vertices reached along src -> dst within a number of hops, at their least hop.

    One join and one anti-join per hop; edges: (src, dst), starts: (start).
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = cut_lineage(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop")).distinct())
    edge_of = seen
    for hop in range(1, hops + 1):
        step = edge_of.join(e, edge_of["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        edge_of = cut_lineage(step.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if edge_of.isEmpty():
            break
        seen = seen.unionByName(edge_of)
    return seen


def co_changes(commits: DataFrame, least: int = 2) -> DataFrame:
    """(file_a < file_b, shared_commits) of files in the same commit; commits: (commit, file), each pair once."""
    c = commits.where("commit is not null and file is not null").distinct()
    a, b = c.withColumnRenamed("file", "file_a"), c.withColumnRenamed("file", "file_b")
    return a.join(b, "commit").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("shared_commits")).where(F.col("shared_commits") >= least)


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-12) -> DataFrame:
    """(id, rank) after a number of rounds, starting at 1/n; ranks of vertices without out-edges aren't redistributed.

    edges: (src, dst), distinct. Each round is one join and one partial sum; written every fifth round.
    Rounds end early once five of them moved all ranks together by at most `tolerance`: five rounds
    shrink any distance by q = damping^5, so all further ones move them by at most q / (1 - q) times that (0.8 at 0.85).
    """
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    vertices = cut_lineage(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())
    n = vertices.count()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    weighted = cut_lineage(e.join(out, "src").select("src", "dst", (1 / F.col("_out")).alias("w")))
    ranks = vertices.withColumn("rank", F.lit(1.0 / max(1, n)))
    # Each vertex with its rank when it was last written.
    written, before = ranks.select("id", F.col("rank").alias("_was")), None
    for i in range(rounds):
        given = weighted.join(ranks, weighted["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("_in"))
        ranks = written.join(given, written["id"] == given["dst"], "left").select("id", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"), "_was")
        if i % 5 == 4:
            ranks = cut_lineage(ranks)
            if before is not None:
                release(before)
            before = ranks
            moved = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("_was")))).first()[0] or 0.0
            if moved <= tolerance:
                break
            written = ranks.select("id", F.col("rank").alias("_was"))
            free_shuffles(edges.sparkSession)
    return ranks.select("id", "rank")


def topological_levels(edges: DataFrame) -> DataFrame | None:
    """(id, level) with level 0 for vertices without in-edges, by peeling; None if there is a cycle."""
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left = cut_lineage(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())
    done, level = None, 0
    while not left.isEmpty():
        ready = cut_lineage(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if ready.isEmpty():
            return None
        part = ready.withColumn("level", F.lit(level))
        done = part if done is None else done.unionByName(part)
        left = cut_lineage(left.join(ready, "id", "left_anti"))
        e = cut_lineage(e.join(ready.withColumnRenamed("id", "src"), "src", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


_STEPS = 4


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components, each named by its least id.

    Forward-backward colouring: every vertex takes the least id that reaches it; the vertices that
    reach back to their colour's root within the colour form its component and leave the graph.
    """
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null and src != dst").distinct())
    left = cut_lineage(edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct())
    done = None
    while True:
        # Vertices that nothing enters, or that nothing leaves, are components of their own.
        while True:
            inner = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            kept = cut_lineage(e.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
            shrunk = kept.count() < e.count()
            e = kept
            if not shrunk:
                break
        core = e.select(F.col("src").alias("id")).distinct()
        alone = cut_lineage(left.join(core, "id", "left_anti").select("id", F.col("id").alias("component")))
        done = alone if done is None else done.unionByName(alone)
        left = cut_lineage(core)
        if left.isEmpty():
            break
        color, sign = left.withColumn("c", F.col("id")), None
        while True:
            # Several steps of propagation for each one that is written.
            for _ in range(_STEPS):
                better = e.join(color, e["src"] == color["id"]).groupBy("dst").agg(F.min("c").alias("m"))
                color = color.join(better, color["id"] == better["dst"], "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"))
            color = cut_lineage(color)
            if sign is not None:
                release(written)
            written = color
            last, sign = sign, color.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
            if sign == last:
                break
        inside = cut_lineage(e.join(color.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        back, size = color.where("id = c"), -1
        while True:
            for _ in range(_STEPS):
                step = inside.join(back.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c")
                back = back.unionByName(step).distinct()
            back = cut_lineage(back)
            last, size = size, back.count()
            if size == last:
                break
        part = back.select("id", F.col("c").alias("component"))
        done = done.unionByName(part)
        left = cut_lineage(left.join(back, "id", "left_anti"))
        e = cut_lineage(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    out = done
    # The root is the least id that reaches the component; its own least id names it.
    least = out.groupBy("component").agg(F.min("id").alias("_m"))
    return out.join(least, "component").select("id", F.col("_m").alias("component"))


def coupling(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, ca, ce, instability, abstraction, distance): modules that depend on it, that it depends on, ce / (ca + ce),
    the share of abstract symbols, and |abstraction + instability - 1|; edges: (src, dst) of ids, modules: (id, module, is_abstract)."""
    m1, m2 = modules.select(F.col("id").alias("src"), F.col("module").alias("_a")), modules.select(F.col("id").alias("dst"), F.col("module").alias("_b"))
    pairs = edges.select("src", "dst").join(m1, "src").join(m2, "dst").where("_a != _b").select("_a", "_b").distinct()
    ce = pairs.groupBy(F.col("_a").alias("module")).agg(F.count(F.lit(1)).alias("ce"))
    ca = pairs.groupBy(F.col("_b").alias("module")).agg(F.count(F.lit(1)).alias("ca"))
    share = F.avg(F.coalesce("is_abstract", F.lit(False)).cast("double")).alias("abstraction")
    both = modules.where("module is not null").groupBy("module").agg(share).join(ca, "module", "left").join(ce, "module", "left").na.fill(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    out = both.select("module", "ca", "ce", F.when(total == 0, 0.0).otherwise(F.col("ce") / total).alias("instability"), "abstraction")
    return out.withColumn("distance", F.abs(F.col("abstraction") + F.col("instability") - 1))


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """(cycle, length): the sets of vertices, sorted, of directed cycles of at most `most` vertices, each once.

    Paths grow from their least vertex on, one join a step; only vertices that are entered and left take part.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    inner = e.select(F.col("src").alias("v")).intersect(e.select(F.col("dst").alias("v")))
    e = cut_lineage(e.join(inner.withColumnRenamed("v", "src"), "src", "left_semi").join(inner.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    found = e.where("src = dst").select(F.array("src").alias("cycle"))
    paths = e.where("src < dst").select(F.array("src", "dst").alias("p"))
    for n in range(2, most + 1):
        last = paths.withColumn("src", F.element_at("p", -1)).join(e, "src")
        found = found.unionByName(last.where(F.col("dst") == F.col("p")[0]).select(F.array_sort("p").alias("cycle")))
        if n < most:
            paths = cut_lineage(last.where((F.col("dst") > F.col("p")[0]) & ~F.array_contains("p", F.col("dst"))).select(F.concat("p", F.array("dst")).alias("p")))
    return found.distinct().select("cycle", F.size("cycle").alias("length"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): shares of shortest paths that lead through each vertex, times 2 / ((n - 1)(n - 2)).

    sources: (id) from which paths start; all vertices without it. Paths of all sources are counted level
    by level outwards, one join a level, and their shares summed up inwards.
    """
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null and src != dst").distinct())
    vertices = cut_lineage(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    n = vertices.count()
    front = cut_lineage((vertices if sources is None else sources.select("id").distinct().join(vertices, "id", "left_semi")).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("s", "id")
    while True:
        step = front.join(e, front["id"] == e["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut_lineage(step.join(seen, ["s", "id"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = cut_lineage(seen.unionByName(front.select("s", "id")))
    total, below = None, None
    for level in reversed(levels):
        here = level.withColumn("d", F.lit(0.0))
        if below is not None:
            far = below.select("s", F.col("id").alias("dst"), (F.lit(1.0) + F.col("d")).alias("_d"), F.col("paths").alias("_p"))
            given = level.join(e, level["id"] == e["src"]).select("s", "id", "paths", "dst").join(far, ["s", "dst"]).groupBy("s", "id").agg(F.sum(F.col("paths") / F.col("_p") * F.col("_d")).alias("_in"))
            here = level.join(given, ["s", "id"], "left").select("s", "id", "paths", F.coalesce("_in", F.lit(0.0)).alias("d"))
        below = cut_lineage(here)
        part = below.where("s != id").select("id", "d")
        total = part if total is None else total.unionByName(part)
    factor = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    summed = (total if total is not None else vertices.select("id", F.lit(0.0).alias("d"))).groupBy("id").agg(F.sum("d").alias("_b"))
    return vertices.join(summed, "id", "left").select("id", (F.coalesce("_b", F.lit(0.0)) * factor).alias("betweenness"))
