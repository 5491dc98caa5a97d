"""Queries over parsed rows, resolved edges, builds and module groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import adapters, assemble, boundary, graph, resolve, scan
from codelode.plans.registry import query
from codelode.sources import views
from codelode.sources.views import EDGES, FILES, SYMBOLS

SPAN = str(assemble.SPAN)


def _parsed(spark, d):
    """Rows as a parser and its rules leave them: symbols by place in their file, some dropped; edges by place or name."""
    s = views.symbols(spark, d).select("file_id", (F.col("id") % 1000000).alias("local"), "name", "kind", "lang", "start_byte", "end_byte", (F.col("parent_id") % 1000000).alias("parent_local"))
    e = views.edges(spark, d).select("file_id", (F.col("id") % 1000000).alias("src_local"), "dst_name", "relation")
    to = F.when((F.col("src_local") % 5 == 0) & (F.col("src_local") > 0), F.col("src_local") - 1)
    return s.where("local % 11 <> 7"), e.withColumn("dst_local", to)


PARSED = "WITH " + EDGES + """, ps AS (SELECT file_id, id % 1000000 AS local, name, kind, lang, start_byte, end_byte, parent_id % 1000000 AS parent_local FROM symbols WHERE (id % 1000000) % 11 <> 7),
pe AS (SELECT file_id, id % 1000000 AS src_local, dst_name, relation, CASE WHEN (id % 1000000) % 5 = 0 AND id % 1000000 > 0 THEN id % 1000000 - 1 END AS dst_local FROM edges)"""


@query(
    PARSED + f""" SELECT p.file_id * {SPAN} + p.local AS id, p.file_id, p.name, CASE WHEN u.local IS NOT NULL THEN p.file_id * {SPAN} + p.parent_local END AS parent_id
FROM ps p LEFT JOIN ps u ON u.file_id = p.file_id AND u.local = p.parent_local"""
)
def enrich_symbol_ids(spark, d):
    return assemble.symbols(_parsed(spark, d)[0]).select("id", "file_id", "name", "parent_id")


@query(
    PARSED + f""", f AS (SELECT file_id, name, min(local) AS first FROM ps WHERE lang IN ('de', 'es') OR kind IN ('class', 'struct', 'interface') GROUP BY 1, 2),
j AS (SELECT e.file_id, e.src_local, coalesce(e.dst_local, f.first) AS dst, e.dst_name, e.relation FROM pe e JOIN ps s ON s.file_id = e.file_id AND s.local = e.src_local
 LEFT JOIN ps t ON t.file_id = e.file_id AND t.local = e.dst_local LEFT JOIN f ON f.file_id = e.file_id AND f.name = e.dst_name WHERE e.dst_local IS NULL OR t.local IS NOT NULL)
SELECT file_id, file_id * {SPAN} + src_local AS src_symbol_id, file_id * {SPAN} + dst AS dst_symbol_id, dst_name, relation FROM j"""
)
def enrich_edge_endpoints(spark, d):
    s, e = _parsed(spark, d)
    return assemble.edges(e, s, ("de", "es")).select("file_id", "src_symbol_id", "dst_symbol_id", "dst_name", "relation")


DIRECT = "CASE WHEN id % 17 = 3 THEN id + 1000000 END"


def _linked(spark, d):
    """Edges some of which know their target, and symbols by zone."""
    e = views.edges(spark, d)
    s = views.symbols(spark, d).select("id", "name", "path", "start_byte", "end_byte")
    known = e.join(s.select((F.col("id") - 1000000).alias("id"), F.col("id").alias("_t")), "id", "left")
    e = known.withColumn("dst_symbol_id", F.when(F.col("id") % 17 == 3, F.col("_t"))).drop("_t")
    return e, boundary.zones(s, "src1")


CODE = "WITH " + EDGES + """, per AS (SELECT name, count(*) AS n, bool_or(end_byte - start_byte > length(name) + 16) AS anyd FROM symbols GROUP BY name),
zs AS (SELECT *, path LIKE 'src1/%' AS inside FROM symbols), def AS (SELECT s.* FROM zs s JOIN per USING (name) WHERE n = 1 OR NOT anyd OR end_byte - start_byte > length(name) + 16),
cand AS (SELECT name, count(*) AS n, min(id) AS one, bool_and(inside) AS inside FROM def GROUP BY name),
el AS (SELECT e.*, s.id AS direct FROM edges e LEFT JOIN symbols s ON s.id = e.id + 1000000 AND e.id % 17 = 3 WHERE NOT regexp_full_match(dst_name, '[A-Z][A-Z0-9_]*_API')),
tt AS (SELECT e.id, src_symbol_id, dst_name, direct, relation, CASE WHEN direct IS NOT NULL THEN 's' || direct WHEN n IS NULL THEN 'dep:' || dst_name WHEN n = 1 THEN 's' || one WHEN inside THEN 'amb:' || dst_name ELSE 'dep:' || dst_name END AS target,
 CASE WHEN direct IS NOT NULL THEN 'direct' WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS confidence, CASE WHEN direct IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS ambiguity FROM el e LEFT JOIN cand c ON c.name = e.dst_name)"""


@query(CODE + " SELECT id, target, confidence, ambiguity FROM tt")
def target_resolution(spark, d):
    return scan.targets(*_linked(spark, d)).select("id", "target", "confidence", "ambiguity")


BUILD = CODE + """, seeds AS (SELECT 's' || id AS id, path, id AS n FROM zs WHERE inside), f1 AS (SELECT s.id AS src, t.target, t.relation, t.confidence, (s.path, s.n, t.relation, t.dst_name, t.direct, t.id) AS o FROM tt t JOIN seeds s ON s.n = t.src_symbol_id),
n1 AS (SELECT id, 0 AS depth FROM seeds UNION ALL SELECT DISTINCT target, 1 FROM f1 WHERE target NOT IN (SELECT id FROM seeds)),
zn AS (SELECT n1.id, depth, CASE WHEN s.inside OR n1.id LIKE 'amb:%' THEN 'target' ELSE 'dependency' END AS zone FROM n1 LEFT JOIN zs s ON n1.id = 's' || s.id)"""


@query(BUILD + " SELECT id, zone, depth FROM zn")
def boundary_build_nodes(spark, d):
    return scan.boundary_build(*_linked(spark, d)).nodes.select("id", "zone", "depth")


@query(BUILD + " SELECT src, target AS dst, relation, count(*) AS weight, arg_max(confidence, o) AS confidence FROM f1 GROUP BY 1, 2, 3")
def boundary_build_edges(spark, d):
    return scan.boundary_build(*_linked(spark, d)).edges


@query(
    BUILD + """, core AS (SELECT DISTINCT t.target AS id FROM tt t JOIN zn ON zn.id = 's' || t.src_symbol_id WHERE depth = 1 AND zone = 'dependency' AND zn.id LIKE 's%')
SELECT id, 2 AS depth FROM core WHERE id NOT IN (SELECT id FROM n1)"""
)
def boundary_build_core(spark, d):
    return scan.boundary_build(*_linked(spark, d), dep_depth=2).nodes.where("depth = 2").select("id", "depth")


@query(
    BUILD + """, sk AS (SELECT id FROM seeds ORDER BY path, n LIMIT 300), fk AS (SELECT * FROM f1 WHERE src IN (SELECT id FROM sk)),
nk AS (SELECT target AS id FROM (SELECT target, min(o) AS o FROM fk WHERE target NOT IN (SELECT id FROM sk) GROUP BY 1) ORDER BY o LIMIT (SELECT 300 - count(*) FROM sk)),
kept AS (SELECT id FROM sk UNION ALL SELECT id FROM nk)
SELECT (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM seeds) - (SELECT count(*) FROM sk) + (SELECT count(*) FROM fk WHERE target NOT IN (SELECT id FROM kept)) AS elided"""
)
def boundary_build_budget(spark, d):
    b = scan.boundary_build(*_linked(spark, d), max_nodes=300)
    return b.nodes.agg(F.count("*").alias("nodes")).withColumn("elided", F.lit(b.elided).cast("long"))


SPEC = [{"name": "One", "include": ["src1", "src11"]}, {"name": "Two", "include": ["src2/en"]}]
ORDER = [z["name"] for z in SPEC]
MODULES = CODE + """, ms AS (SELECT *, CASE WHEN path LIKE 'src1/%' OR path LIKE 'src11/%' THEN 'One' WHEN path LIKE 'src2/en/%' THEN 'Two' ELSE 'External' END AS module FROM symbols),
md AS (SELECT s.* FROM ms s JOIN per USING (name) WHERE n = 1 OR NOT anyd OR end_byte - start_byte > length(name) + 16),
mc AS (SELECT name, count(*) AS n, count(DISTINCT module) AS k, arg_min(id, (path, id)) AS one FROM md GROUP BY name),
mt AS (SELECT e.id, src_symbol_id, relation, CASE WHEN direct IS NOT NULL THEN 's' || direct WHEN n IS NULL THEN 'dep:' || dst_name WHEN k = 1 THEN 's' || one ELSE 'amb:' || dst_name END AS target,
 CASE WHEN direct IS NOT NULL THEN 'direct' WHEN n IS NULL THEN 'unresolved' WHEN k = 1 THEN 'unique' ELSE 'ambiguous' END AS confidence FROM el e LEFT JOIN mc c ON c.name = e.dst_name)"""


def _moduled(spark, d):
    e, s = _linked(spark, d)
    return e, boundary.modules(s.drop("zone"), SPEC).drop("prefix")


@query(MODULES + " SELECT id, target, confidence FROM mt")
def target_resolution_nway(spark, d):
    return scan.module_targets(*_moduled(spark, d)).select("id", "target", "confidence")


@query(
    MODULES + """, sd AS (SELECT 's' || id AS id FROM ms WHERE module <> 'External'), met AS (SELECT DISTINCT target AS id FROM mt WHERE 's' || src_symbol_id IN (SELECT id FROM sd)),
al AS (SELECT id, 0 AS depth FROM sd UNION ALL SELECT id, 1 FROM met WHERE id NOT IN (SELECT id FROM sd))
SELECT al.id, depth, coalesce(m.module, CASE WHEN al.id LIKE 'amb:%' THEN '(ambiguous)' ELSE 'External' END) AS module FROM al LEFT JOIN ms m ON al.id = 's' || m.id"""
)
def modules_build(spark, d):
    return scan.modules_build(*_moduled(spark, d), ORDER).nodes.select("id", "depth", "module")


@query(
    MODULES + """, sd AS (SELECT 's' || id AS src, id FROM ms WHERE module <> 'External')
SELECT src, target AS dst, relation, count(*) AS weight FROM mt JOIN sd ON sd.id = src_symbol_id GROUP BY 1, 2, 3"""
)
def modules_build_edges(spark, d):
    return scan.modules_build(*_moduled(spark, d), ORDER).edges.drop("confidence")


@query(
    MODULES + """, sr AS (SELECT id AS n, path, CASE module WHEN 'One' THEN 0 ELSE 1 END AS decl, row_number() OVER (PARTITION BY module ORDER BY path, id) AS r FROM ms WHERE module <> 'External'),
sk AS (SELECT *, 's' || n AS id FROM sr WHERE r <= 60 ORDER BY r, decl, path, n LIMIT 200),
f1 AS (SELECT t.target, (k.r, k.decl, k.path, k.n, t.relation, e.dst_name, t.id) AS o FROM mt t JOIN sk k ON k.n = t.src_symbol_id JOIN edges e ON e.id = t.id),
nk AS (SELECT target AS id FROM f1 WHERE target NOT IN (SELECT id FROM sk) GROUP BY 1 ORDER BY min(o) LIMIT (SELECT 200 - count(*) FROM sk)),
kept AS (SELECT id, 0 AS depth FROM sk UNION ALL SELECT id, 1 FROM nk),
f2 AS (SELECT target FROM mt WHERE 's' || src_symbol_id IN (SELECT nk.id FROM nk JOIN ms ON nk.id = 's' || ms.id WHERE module <> 'External')),
ed AS (SELECT count(*) AS elided FROM (SELECT target FROM f1 UNION ALL SELECT target FROM f2) WHERE target NOT IN (SELECT id FROM kept))
SELECT k.id, depth, coalesce(m.module, CASE WHEN k.id LIKE 'amb:%' THEN '(ambiguous)' ELSE 'External' END) AS module, elided FROM kept k LEFT JOIN ms m ON k.id = 's' || m.id, ed"""
)
def modules_build_budget(spark, d):
    """200 nodes, 120 of them seeds dealt in the order of declaration; the budget is used up in the first round."""
    b = scan.modules_build(*_moduled(spark, d), ORDER, max_nodes=200)
    return b.nodes.select("id", "depth", "module").withColumn("elided", F.lit(b.elided).cast("long"))


IMPORTS = "WITH " + FILES + ", ie AS (SELECT id AS file_id, (id * 13 + 5) % (SELECT count(*) FROM files) AS dst_file_id FROM files UNION ALL SELECT id, id // 3 FROM files UNION ALL SELECT id, NULL FROM files WHERE id % 4 = 0)"


def _imports(spark, d):
    f = views.files(spark, d).select("id")
    n = f.agg(F.count("*").alias("n"))
    a = f.crossJoin(F.broadcast(n)).select(F.col("id").alias("file_id"), ((F.col("id") * 13 + 5) % F.col("n")).alias("dst_file_id"))  # one row of totals
    return a.unionByName(f.select(F.col("id").alias("file_id"), F.floor(F.col("id") / 3).alias("dst_file_id"))).unionByName(f.where("id % 4 = 0").select(F.col("id").alias("file_id"), F.lit(None).cast("long").alias("dst_file_id"))), f


NEAR = IMPORTS + ", e AS (SELECT DISTINCT file_id AS a, dst_file_id AS b FROM ie WHERE dst_file_id IS NOT NULL AND file_id <> dst_file_id AND dst_file_id IN (SELECT id FROM files))"


@query(NEAR + " SELECT b AS id, a AS other FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a) AS n FROM e) WHERE n <= 2")
def reverse_imports(spark, d):
    return scan.neighbours(*_imports(spark, d), "in", 2)


@query(NEAR + " SELECT a AS id, b AS other FROM e UNION SELECT b, a FROM e")
def file_neighbours(spark, d):
    return scan.neighbours(*_imports(spark, d), "both", None)


@query(
    "WITH " + FILES + """, m AS (SELECT id, source || '/' || lang || '/' || CASE WHEN id % 40 = 3 THEN 'package.json' WHEN id % 90 = 7 THEN 'x.Build.cs' ELSE 'doc' || id END AS path FROM documents_),
r AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM m WHERE lower(path) LIKE '%/package.json' OR lower(path) LIKE '%.build.cs')
SELECT m.id, coalesce((SELECT max(root) FROM r WHERE starts_with(m.path, r.root || '/')), split_part(m.path, '/', 1)) AS grp FROM m""".replace("documents_", "(SELECT doc_id AS id, source, lang FROM documents)")
)
def module_grouping(spark, d):
    f = views.read(spark, d, "documents")
    name = F.when(F.col("doc_id") % 40 == 3, "package.json").when(F.col("doc_id") % 90 == 7, "x.Build.cs").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    m = f.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", name).alias("path"))
    return graph.module_groups(m, m)


@query(
    "WITH " + SYMBOLS + """ SELECT s.id, f.path, s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id IN (SELECT max(id) FROM symbols GROUP BY file_id)"""
)
def symbols_by_id(spark, d):
    """Point lookups of many ids at once: the last symbol of every file."""
    s = views.symbols(spark, d)
    wanted = s.groupBy("file_id").agg(F.max("id").alias("id")).select("id")
    return resolve.by_id(s.select("id", "file_id", "name"), wanted).join(views.files(spark, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path", "name")


RAW = """, raw AS (SELECT DISTINCT id AS file_id, path, 'sub/doc' || (id % 97) || '.en' AS target FROM files),
cand AS (SELECT file_id, target, 0 AS ord, regexp_replace(path, '/[^/]*$', '') || '/' || target AS cand FROM raw UNION ALL SELECT file_id, target, 1, target FROM raw),
hit AS (SELECT c.*, f.id AS dst, f.path AS dp, CASE WHEN f.path = cand THEN 1 WHEN ends_with(f.path, '/' || cand) THEN 2 ELSE 3 END AS stage FROM cand c JOIN files f ON split_part(f.path, '/', -1) = split_part(cand, '/', -1)),
im AS (SELECT file_id AS src, dst FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY stage, CASE WHEN stage = 3 THEN 0 ELSE ord END, length(dp), dp, dst) AS k FROM hit) WHERE k = 1 AND file_id <> dst)"""


def _file_adapter(spark, d):
    f = views.files(spark, d).select("id", "path", "content")
    target = F.concat(F.lit("sub/doc"), (F.col("id") % 97).cast("string"), F.lit(".en"))
    raw = f.select(F.col("id").alias("file_id"), "path", F.lit(1).cast("long").alias("line"), F.lit("include").alias("kind"), target.alias("target"))
    return adapters.FileAdapter(f, views.symbols(spark, d).select("id", "file_id", "name", "path"), raw)


SEEDED = "WITH RECURSIVE " + SYMBOLS + RAW + """, seed AS (SELECT DISTINCT file_id AS id FROM symbols WHERE name = 'La' QUALIFY dense_rank() OVER (ORDER BY path, file_id) <= 25)"""


@query(SEEDED + ", r(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT im.dst, depth + 1 FROM r JOIN im ON im.src = r.id WHERE depth < 3) SELECT 'file:' || id AS id, min(depth) AS depth FROM r GROUP BY id")
def scan_by_file(spark, d):
    """From the files with a symbol of a name to what they import, three levels deep."""
    return adapters.scan_from(_file_adapter(spark, d), "La", 4000, 3).nodes


@query(
    SEEDED.replace("<= 25", "<= 400").replace("'La'", "'The'") + """, lead AS (SELECT dst AS id, src AS by FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM im) WHERE k <= 40),
r(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT lead.by, depth + 1 FROM r JOIN lead ON lead.id = r.id WHERE depth < 2)
SELECT 'file:' || id AS id, min(depth) AS depth FROM r GROUP BY id"""
)
def scan_importers(spark, d):
    """From the same files to what imports them, two levels deep."""
    return adapters.scan_from(_file_adapter(spark, d), "The", 100_000, 2, "in", 400).nodes


@query(
    CODE.replace("WITH ", "WITH RECURSIVE ", 1) + """, seed AS (SELECT 's' || id AS id FROM (SELECT * FROM zs WHERE name = 'The' ORDER BY path, id LIMIT 500) WHERE inside),
r(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT t.target, depth + 1 FROM r JOIN zs ON r.id = 's' || zs.id AND inside JOIN tt t ON t.src_symbol_id = zs.id WHERE depth < 3)
SELECT id, min(depth) AS depth FROM r GROUP BY id"""
)
def scan_by_symbol(spark, d):
    """From the target symbols of a name along resolved edges, three levels deep."""
    return adapters.scan_from(adapters.SymbolAdapter(*_linked(spark, d)), "The", 4000, 3, limit=500).nodes
