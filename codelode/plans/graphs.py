"""Queries over graphs, zones, modules and the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import boundary, graph, strong, trace
from codelode.plans.registry import query
from codelode.sources import recursive, views
from codelode.sources.views import LOG, MEMBERS, NATIONS, NOTES, TRADE, TURNS, WEB

DEDUP = "dd AS (SELECT src, dst, relation, CAST(sum(weight) AS BIGINT) AS weight FROM trade GROUP BY 1, 2, 3)"
GRAPH = "WITH " + TRADE + ", " + DEDUP + ", " + NATIONS
ZONED = GRAPH + ", z AS (SELECT *, CASE WHEN label = 'EUROPE' OR label LIKE 'EUROPE/%' THEN 'target' ELSE 'dependency' END AS zone FROM nodes)"


def _graph(spark, d):
    return graph.dedup_edges(views.trade(spark, d)), views.nations(spark, d)


def _zoned(spark, d):
    e, n = _graph(spark, d)
    return e, boundary.zones(n.withColumn("path", F.col("label")), "EUROPE")


@query("WITH " + TRADE + ", " + DEDUP + " SELECT * FROM dd")
def edge_dedup_weight(spark, d):
    return graph.dedup_edges(views.trade(spark, d))


@query(GRAPH + " SELECT a.module AS gs, b.module AS gd, relation, CAST(sum(weight) AS BIGINT) AS weight FROM dd JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.module <> b.module GROUP BY 1, 2, 3")
def rollup_dir(spark, d):
    e, n = _graph(spark, d)
    return graph.rollup(e, n.select("id", F.col("module").alias("grp")))[1]


@query("WITH " + NATIONS + " SELECT module AS grp, count(*) AS members FROM nodes GROUP BY 1")
def rollup_module(spark, d):
    e, n = _graph(spark, d)
    return graph.rollup(e, n.select("id", F.col("module").alias("grp")))[0]


COUPLED = """, c AS (SELECT id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM members LEFT JOIN (SELECT dst AS id, count(*) AS ca FROM web GROUP BY 1) USING (id)
 LEFT JOIN (SELECT src AS id, count(*) AS ce FROM web GROUP BY 1) USING (id))"""


@query("WITH " + WEB + ", " + MEMBERS + COUPLED + " SELECT CAST(id AS BIGINT) AS id, ca, ce, CASE WHEN ca + ce = 0 THEN 0.0 ELSE round(ce / (ca + ce), 3) END AS instability FROM c")
def node_coupling(spark, d):
    return graph.coupling(views.members(spark, d), views.web(spark, d))


BFS = """WITH RECURSIVE """ + WEB + """, r(id, depth) AS (SELECT min(src), 0 FROM web UNION SELECT web.dst, r.depth + 1 FROM r JOIN web ON web.src = r.id WHERE r.depth < 3),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"""


@query(BFS + " SELECT CAST(id AS BIGINT) AS id, CAST(depth AS INTEGER) AS depth FROM m")
def bfs_bounded(spark, d):
    e = views.web(spark, d)
    return graph.bfs_bounded(e, e.agg(F.min("src").alias("id")), 200, 3, "out").nodes


@query(
    BFS + """, c AS (SELECT k, (SELECT count(*) FROM m WHERE depth <= k) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS k)),
t AS (SELECT max(k) AS top FROM c WHERE (SELECT bool_and(b.n <= 4) FROM c b WHERE b.k <= c.k))
SELECT (SELECT count(*) FROM m WHERE depth <= top) AS n_nodes, coalesce((SELECT count(*) > 0 FROM m WHERE depth = top + 1), false) AS truncated,
 CAST(least(top, (SELECT max(depth) FROM m)) AS INTEGER) AS frontier_depth, (SELECT count(*) FROM m WHERE depth = top + 1) AS elided FROM t"""
)
def bfs_truncated_accounting(spark, d):
    e = views.web(spark, d)
    s = graph.bfs_bounded(e, e.agg(F.min("src").alias("id")), 4, 3, "out")
    one = s.nodes.agg(F.count("*").alias("n_nodes"))
    return one.select("n_nodes", F.lit(s.truncated).alias("truncated"), F.lit(s.frontier_depth).alias("frontier_depth"), F.lit(s.elided).cast("long").alias("elided"))


@query(
    "WITH RECURSIVE " + TURNS + """, ids AS (SELECT src AS id FROM turns UNION SELECT dst FROM turns),
r(id, layer) AS (SELECT id, 0 FROM ids WHERE id NOT IN (SELECT dst FROM turns) UNION ALL SELECT turns.dst, r.layer + 1 FROM r JOIN turns ON turns.src = r.id)
SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM r GROUP BY id"""
)
def toposort_layers(spark, d):
    return graph.layers(views.turns(spark, d))[0]


REACH = "WITH RECURSIVE " + WEB + ", reach(a, b) AS (SELECT src, dst FROM web UNION SELECT reach.a, web.dst FROM reach JOIN web ON web.src = reach.b), ids AS (SELECT src AS id FROM web UNION SELECT dst FROM web)"


@query(
    REACH + """, s AS (SELECT x.a AS id, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a UNION SELECT id, id FROM ids)
SELECT id, min(other) AS component, count(*) AS size, count(*) > 1 AS cyclic FROM s GROUP BY id"""
)
def scc_cycles(spark, d):
    return strong.strong_components(views.web(spark, d))


SPARSE = WEB.replace("% 9 = 5", "% 23 = 5")
UNDIRECTED = SPARSE + """, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM web GROUP BY 1, 2),
adj AS (SELECT a AS s, b AS t, a, b FROM u UNION ALL SELECT b, a, a, b FROM u)"""


@query(
    "WITH RECURSIVE " + UNDIRECTED + """, r(a, b, cur) AS (SELECT a, b, a FROM u WHERE n = 1 UNION SELECT r.a, r.b, adj.t FROM r JOIN adj ON adj.s = r.cur AND NOT (adj.a = r.a AND adj.b = r.b))
SELECT a, b FROM u WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = u.a AND r.b = u.b AND r.cur = u.b)"""
)
def bridges(spark, d):
    return graph.bridges(graph.slices(views.web(spark, d, 23))).drop("slice")


@query(
    "WITH RECURSIVE " + UNDIRECTED + """, near AS (SELECT s AS x, min(t) AS first FROM adj GROUP BY s),
r(x, cur) AS (SELECT x, first FROM near UNION SELECT r.x, adj.t FROM r JOIN adj ON adj.s = r.cur AND adj.t <> r.x)
SELECT DISTINCT adj.s AS id FROM adj WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.x = adj.s AND r.cur = adj.t)"""
)
def cut_nodes(spark, d):
    return graph.cut_nodes(graph.slices(views.web(spark, d, 23))).drop("slice")


@query(
    "WITH RECURSIVE " + UNDIRECTED + """, near AS (SELECT s AS x, min(t) AS first FROM adj GROUP BY s),
r(x, cur) AS (SELECT x, first FROM near UNION SELECT r.x, adj.t FROM r JOIN adj ON adj.s = r.cur AND adj.t <> r.x),
k AS (SELECT DISTINCT adj.s AS id FROM adj WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.x = adj.s AND r.cur = adj.t)), """ + MEMBERS + COUPLED + """,
o AS (SELECT list_sort(list(ca)) AS al FROM c), g AS (SELECT greatest(2, al[CAST(least(floor(90 * len(al) / 100), len(al) - 1) AS INTEGER) + 1]) AS gate FROM o)
SELECT CAST(c.id AS BIGINT) AS id, ca + ce AS deg, ca AS fan_in, ce AS fan_out, c.id IN (SELECT id FROM k) OR ca >= gate AS hub FROM c, g"""
)
def importance_hubs(spark, d):
    e = views.web(spark, d, 23)
    return graph.hubs(views.members(spark, d), e, graph.cut_nodes(graph.slices(e)))


@query(ZONED + " SELECT id, zone FROM z")
def zone_binary(spark, d):
    return _zoned(spark, d)[1].select("id", "zone")


X = ZONED + ", x AS (SELECT dd.* FROM dd JOIN z a ON a.id = src JOIN z b ON b.id = dst WHERE a.zone = 'target' AND b.zone = 'dependency')"


@query(X + " SELECT id FROM z WHERE zone = 'target' AND id IN (SELECT src FROM x)")
def boundary_nodes(spark, d):
    return boundary.boundary_nodes(*_zoned(spark, d)).select("id")


@query(X + " SELECT src, dst, relation, weight FROM x")
def crossings(spark, d):
    return boundary.crossings(*_zoned(spark, d)).select("src", "dst", "relation", "weight").orderBy("src", "dst", "relation")


@query(X + " SELECT src, module, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM x JOIN nodes ON id = dst GROUP BY 1, 2")
def dependency_surface(spark, d):
    e, n = _zoned(spark, d)
    return boundary.surface(e, n, F.col("module"))


@query(ZONED + " SELECT dd.src, dd.dst, dd.relation, dd.weight FROM dd JOIN z a ON a.id = src JOIN z b ON b.id = dst WHERE a.zone = 'target' AND b.zone = 'target'")
def internal_view(spark, d):
    return boundary.internal(*_zoned(spark, d)).select("src", "dst", "relation", "weight")


@query(
    "WITH " + WEB + ", " + MEMBERS + """, z AS (SELECT *, CASE WHEN label LIKE 'EUROPE/%' THEN 'target' ELSE 'dependency' END AS zone FROM members),
x AS (SELECT web.* FROM web JOIN z a ON a.id = src JOIN z b ON b.id = dst WHERE a.zone = 'target' AND b.zone = 'dependency')
SELECT id, CASE WHEN zone = 'target' AND id NOT IN (SELECT src FROM x) THEN 0 WHEN zone = 'target' THEN 1 WHEN id IN (SELECT dst FROM x) THEN 2 ELSE 3 END AS band FROM z"""
)
def bands_four(spark, d):
    n = boundary.zones(views.members(spark, d).withColumn("path", F.col("label")), "EUROPE")
    return boundary.bands(views.web(spark, d), n).select("id", "band")


SPEC = [{"name": "West", "include": ["src1", "src1/fr", "src2"], "exclude": ["src1/de"]}, {"name": "French", "include": ["src1/fr"]}, {"name": "Rest", "include": ["src3/"], "exclude": ["*doc3*"]}]
NWAY = "WITH " + views.FILES + """, mm AS (SELECT id, path, CASE WHEN path LIKE 'src1/fr/%' THEN 'West' WHEN path LIKE 'src1/%' AND path NOT LIKE 'src1/de/%' THEN 'West' WHEN path LIKE 'src2/%' THEN 'West'
 WHEN path LIKE 'src3/%' AND NOT contains(path, 'doc3') THEN 'Rest' ELSE 'External' END AS module FROM files)"""


@query(NWAY + " SELECT id, module FROM mm")
def zone_nway_longest_prefix(spark, d):
    return boundary.modules(views.files(spark, d).select("id", "path"), SPEC).select("id", "module")


@query(NWAY + " SELECT id, module, rn FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY path, id) AS rn FROM mm) WHERE rn <= 5")
def nway_round_robin_seeds(spark, d):
    m = boundary.modules(views.files(spark, d).select("id", "path"), SPEC)
    decl = F.when(F.col("module") == "West", 0).when(F.col("module") == "French", 1).when(F.col("module") == "Rest", 2).otherwise(3)
    return boundary.round_robin(m.withColumn("zone", F.col("module")).withColumn("decl", decl), 5).select("id", "module", "rn")


PAIRS = GRAPH + ", p AS (SELECT dd.*, a.module AS sm, b.module AS dm, b.label AS label FROM dd JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)"


@query(PAIRS + " SELECT sm, dm, count(*) AS edge_count, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM p GROUP BY 1, 2")
def zone_matrix(spark, d):
    return boundary.matrix(*_graph(spark, d))


@query(PAIRS + " SELECT sm, dm, relation, count(*) AS edge_count FROM p GROUP BY 1, 2, 3")
def zone_matrix_by_relation(spark, d):
    return boundary.matrix_by_relation(*_graph(spark, d))


@query(PAIRS + " SELECT sm, dm, dst, label, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, count(DISTINCT src) AS ref_count FROM p WHERE sm <> dm GROUP BY 1, 2, 3, 4")
def needed_symbols(spark, d):
    return boundary.needed(*_graph(spark, d))


@query(PAIRS + " SELECT sm, dm, count(DISTINCT dst) AS cost, count(*) AS edge_count FROM p WHERE sm <> dm GROUP BY 1, 2")
def cut_costs(spark, d):
    return boundary.cut_costs(*_graph(spark, d))


@query(
    PAIRS + """, f AS (SELECT module, (SELECT count(*) FROM p WHERE dm = module AND sm <> dm) AS fan_in, (SELECT count(*) FROM p WHERE sm = module AND sm <> dm) AS fan_out FROM (SELECT DISTINCT module FROM nodes))
SELECT module, fan_in, fan_out, CASE WHEN fan_in + fan_out = 0 THEN 0.0 ELSE round(fan_out / (fan_in + fan_out), 4) END AS instability FROM f"""
)
def module_fan_stats(spark, d):
    return boundary.fan_stats(*_graph(spark, d))


@query(
    "WITH RECURSIVE " + WEB + ", " + MEMBERS + """, q AS (SELECT DISTINCT a.m AS src, b.m AS dst FROM web JOIN members a ON a.id = src JOIN members b ON b.id = dst WHERE a.m <> b.m AND (a.m + b.m) % 7 = 3),
reach(a, b) AS (SELECT src, dst FROM q UNION SELECT reach.a, q.dst FROM reach JOIN q ON q.src = reach.b), ids AS (SELECT src AS id FROM q UNION SELECT dst FROM q),
s AS (SELECT x.a AS id, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a UNION SELECT id, id FROM ids)
SELECT id, min(other) AS component, count(*) AS size FROM s GROUP BY id"""
)
def module_cycles(spark, d):
    n = views.members(spark, d)
    e = views.web(spark, d).join(n.select(F.col("id").alias("src"), F.col("m").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("m").alias("b")), "dst")
    q = e.where("a <> b AND (a + b) % 7 = 3").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return strong.strong_components(q).select("id", "component", "size")


@query("WITH " + WEB + ", " + MEMBERS + COUPLED + " SELECT c.id::BIGINT AS id FROM c JOIN members n ON n.id = c.id WHERE n.label NOT LIKE 'EUROPE/%' AND (n.label LIKE 'ASIA/%' OR c.ca >= 3)")
def view_hide(spark, d):
    n = views.members(spark, d)
    fan = graph.coupling(n, views.web(spark, d)).select("id", F.col("ca").alias("fan_in"))
    z = boundary.zones(n.withColumn("path", F.col("label")), "EUROPE").join(fan, "id")
    return boundary.hidden(z, patterns=["ASIA/*"], min_fan_in=3).select("id")


@query("WITH " + MEMBERS + ", " + WEB + " SELECT src, dst FROM web WHERE src IN (SELECT id FROM members WHERE module IN ('ASIA', 'EUROPE')) AND dst IN (SELECT id FROM members WHERE module IN ('ASIA', 'EUROPE'))")
def induced_subgraph(spark, d):
    return graph.induced(views.members(spark, d).where("module IN ('ASIA', 'EUROPE')"), views.web(spark, d)).select("src", "dst")


@query("WITH RECURSIVE " + WEB + ", r(id) AS (SELECT min(src) FROM web UNION SELECT web.dst FROM r JOIN web ON web.src = r.id) SELECT id FROM r")
def chain_descendants(spark, d):
    e = views.web(spark, d)
    return graph.reachable(e, e.agg(F.min("src").alias("id")))


@query("WITH RECURSIVE " + WEB + ", r(id) AS (SELECT max(dst) FROM web UNION SELECT web.src FROM r JOIN web ON web.dst = r.id) SELECT id FROM r")
def chain_ancestors(spark, d):
    e = views.web(spark, d)
    return graph.reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), e.agg(F.max("dst").alias("id")))


@query(
    "WITH RECURSIVE " + UNDIRECTED + """, w(id, r) AS (SELECT s, s FROM adj UNION SELECT adj.t, w.r FROM w JOIN adj ON adj.s = w.id)
SELECT id, min(r) AS component FROM w GROUP BY id"""
)
def weak_components(spark, d):
    return graph.weak_components(views.web(spark, d, 23))


@query(
    "WITH RECURSIVE " + SPARSE + ", " + MEMBERS + COUPLED + """, f AS (SELECT id, label, ca, ce, CASE WHEN ca + ce = 0 THEN 0.0 ELSE round(ce / (ca + ce), 3) END AS inst FROM c JOIN members USING (id)),
reach(a, b) AS (SELECT src, dst FROM web UNION SELECT reach.a, web.dst FROM reach JOIN web ON web.src = reach.b),
s AS (SELECT x.a AS id, min(x.b) AS comp FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT (SELECT count(*) FROM f) AS nodes, (SELECT count(*) FROM web) AS edges, (SELECT count(DISTINCT comp) FROM s) AS cycles,
 (SELECT arg_min(label, (-inst, -ce, id)) FROM f) AS most_unstable, (SELECT arg_min(label, (-ca, -inst, -ce, id)) FROM f) AS most_depended_on"""
)
def metrics_summary(spark, d):
    e = views.web(spark, d, 23)
    return graph.metrics(views.members(spark, d), e, strong.strong_components(e))


@query(
    "WITH RECURSIVE " + WEB + ", " + MEMBERS + """, q AS (SELECT src, count(DISTINCT dst) AS n FROM web GROUP BY 1)
SELECT module AS grp, count(*) AS members, CAST(coalesce(sum(q.n), 0) AS BIGINT) AS frontier FROM members LEFT JOIN q ON q.src = id GROUP BY 1"""
)
def rollup_frontier(spark, d):
    """The fan-outs of all nodes, taken as a frontier, by module."""
    n = views.members(spark, d).select("id", F.col("module").alias("grp"))
    frontier = views.web(spark, d).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))
    return graph.rollup_frontier(n, frontier)


ZONED_MEMBERS = "WITH " + WEB + ", " + MEMBERS + """, z AS (SELECT *, CASE WHEN label LIKE 'EUROPE/%' THEN 'target' ELSE 'dependency' END AS zone FROM members)"""


def _zoned_members(spark, d):
    return boundary.zones(views.members(spark, d).withColumn("path", F.col("label")), "EUROPE")


@query("WITH " + MEMBERS + " SELECT id, 0 AS band FROM members")
def bands_flat(spark, d):
    return boundary.flat_bands(views.members(spark, d)).select("id", "band")


@query(ZONED_MEMBERS + " SELECT id, CASE WHEN zone = 'target' THEN 0 ELSE 1 END AS band FROM z")
def bands_two(spark, d):
    return boundary.two_bands(_zoned_members(spark, d)).select("id", "band")


@query("WITH " + MEMBERS + " SELECT id, CASE module WHEN 'ASIA' THEN 0 WHEN 'AFRICA' THEN 1 ELSE 2 END AS band FROM members")
def bands_nway(spark, d):
    """Of the declared names one and the fallback do not occur, so three places are left."""
    return boundary.module_bands(views.members(spark, d), ["ASIA", "NOWHERE", "AFRICA"]).select("id", "band")


@query(
    ZONED_MEMBERS + """, n AS (SELECT CASE WHEN zone = 'target' THEN 'target' ELSE 'dependency' END AS side, CASE WHEN zone = 'target' THEN left(label, length(label) - length(split_part(label, '/', -1)) - 1) ELSE module END AS label, CASE WHEN zone = 'target' THEN 0 ELSE 1 END AS band FROM z)
SELECT side || ':' || label AS grp, side, label, count(*) AS members, min(band) AS band FROM n GROUP BY side, label"""
)
def super_nodes(spark, d):
    return boundary.super_nodes(boundary.two_bands(_zoned_members(spark, d)), F.col("module"), "dir")[1]


@query(
    ZONED_MEMBERS + """, n AS (SELECT id, zone, CASE WHEN module = 'ASIA' THEN CAST(id AS VARCHAR) ELSE module END AS rep FROM z)
SELECT a.rep AS src, b.rep AS dst, count(*) AS edges, bool_or(a.zone <> b.zone) AS "cross", bool_or(web.src % 5 = 0) AS bridge FROM web JOIN n a ON a.id = web.src JOIN n b ON b.id = web.dst WHERE a.rep <> b.rep GROUP BY 1, 2"""
)
def quotient_graph(spark, d):
    """All modules but ASIA are collapsed; edges from every fifth node stand for bridges."""
    n = _zoned_members(spark, d)
    e = boundary.classify(views.web(spark, d), n).where("src_zone IS NOT NULL AND dst_zone IS NOT NULL").withColumn("bridge", F.col("src") % 5 == 0)
    groups = n.select("id", F.col("module").alias("grp"))
    return boundary.quotient(e, groups, groups.where("grp <> 'ASIA'"))


@query(
    "WITH " + WEB + """, e AS (SELECT src, dst, 'calls' AS relation FROM web), k AS (SELECT *, CASE src % 3 WHEN 0 THEN 'ambiguous' ELSE 'name-only' END AS confidence FROM e WHERE dst % 4 <> 1)
SELECT e.*, coalesce(confidence, 'direct') AS confidence FROM e LEFT JOIN k USING (src, dst, relation)"""
)
def confidence_carry(spark, d):
    e = views.web(spark, d).withColumn("relation", F.lit("calls"))
    known = e.where("dst % 4 <> 1").withColumn("confidence", F.when(F.col("src") % 3 == 0, "ambiguous").otherwise("name-only"))
    return boundary.carried_confidence(e, known)


@query()
def toposort_order(spark, d):
    """No SQL: a place follows from the places before it. Tests compare with a plain queue."""
    return graph.topological_order(views.turns(spark, d))[0]


LATEST = "WITH " + LOG + ", " + NOTES + ", n AS (SELECT log_id, max_by(note, id) AS note, max_by(tag, id) AS tag, max_by(status, id) AS status FROM notes GROUP BY 1), ln AS (SELECT qlog.*, note, tag, status FROM qlog LEFT JOIN n ON log_id = qlog.id)"


@query(LATEST + " SELECT id, note, tag, status FROM ln")
def trace_latest_note(spark, d):
    return trace.with_latest_note(views.log(spark, d), views.notes(spark, d)).select("id", "note", "tag", "status")


@query("WITH " + LOG + ", " + NOTES + " SELECT qlog.id, note FROM qlog LEFT JOIN notes ON log_id = qlog.id")
def trace_view(spark, d):
    return trace.view(views.log(spark, d), views.notes(spark, d)).select("id", "note")


@query(
    LATEST + """, p AS (SELECT *, CASE WHEN kind = 'static' OR note IS NOT NULL THEN 1 ELSE 2 END AS section FROM ln WHERE (status IS NULL OR status = 'active') AND contains(lower(concat_ws(' ', sql_text, task_tag, tag, note)), 'task3'))
SELECT id, section, rank, CASE WHEN kind = 'dynamic' AND DATE '2024-06-01' - valid_date > 30 THEN true ELSE false END AS stale FROM (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY ts DESC, id DESC) AS INTEGER) AS rank FROM p) WHERE rank <= 12"""
)
def trace_preflight(spark, d):
    return trace.preflight(views.log(spark, d), views.notes(spark, d), "2024-06-01", terms=["TASK3"]).select("id", "section", "rank", "stale")


@query(
    "WITH " + LOG + """, st AS (SELECT doc_id AS k, n_chars FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT qlog.*, DATE '2024-06-01' - valid_date AS age FROM qlog)
SELECT c.id, CASE WHEN c.kind <> 'dynamic' THEN NULL WHEN age > 200 THEN 'age ' || age || 'd' WHEN st.k IS NULL THEN 'missing doc' || c.k WHEN c.k % 2 = 1 THEN 'mtime changed doc' || c.k WHEN st.n_chars <> 100 THEN 'size changed doc' || c.k END AS reason
FROM c LEFT JOIN st ON st.k = c.k"""
)
def trace_stale(spark, d):
    k = F.col("k").cast("string")
    was = F.struct(F.concat(F.lit("doc"), k).alias("path"), (F.col("k") % 2).alias("mtime"), F.lit(100).cast("long").alias("size"))
    log = views.log(spark, d).withColumn("file_state", F.array(was))
    docs = views.read(spark, d, "documents").where("doc_id % 3 <> 0")
    state = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.lit(0).alias("mtime"), F.col("n_chars").alias("size"))
    return trace.stale(log, "2024-06-01", 200, state).select("id", "reason")


@query(LATEST + " SELECT id FROM ln WHERE contains(lower(concat_ws(' ', sql_text, task_tag, tag, note)), 'purchase') AND contains(lower(concat_ws(' ', sql_text, task_tag, tag, note)), 'task5')")
def trace_search(spark, d):
    return trace.with_latest_note(views.log(spark, d), views.notes(spark, d)).where(trace.matches(["Purchase", "task5"])).select("id")


CHAINS = "r(top, id, steps) AS (SELECT src, dst, 1 FROM turns UNION SELECT r.top, t.dst, r.steps + 1 FROM r JOIN turns t ON t.src = r.id)"


@query("WITH RECURSIVE " + TURNS + ", " + CHAINS + " SELECT top, id, steps FROM r")
def recursive_chains(spark, d):
    """Every turn with all the turns before it: a recursive table over an acyclic graph."""
    views.turns(spark, d).createOrReplaceTempView("codelode_turns")
    return recursive.run("WITH RECURSIVE turns AS (SELECT * FROM codelode_turns), " + CHAINS + " SELECT top, id, steps FROM r", spark.sql)


REACH = "r(id) AS (SELECT min(src) FROM web UNION SELECT w.dst FROM r JOIN web w ON w.src = r.id)"


@query("WITH RECURSIVE " + WEB + ", " + REACH + " SELECT id FROM r")
def recursive_reach(spark, d):
    """What the first node leads to in a graph with cycles."""
    views.web(spark, d).createOrReplaceTempView("codelode_web")
    return recursive.run("WITH RECURSIVE web AS (SELECT * FROM codelode_web), " + REACH + " SELECT id FROM r", spark.sql)
