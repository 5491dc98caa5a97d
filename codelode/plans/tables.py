"""Queries over the engine tables: counts, search, probes, names, imports, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode import scratch
from codelode.functions import paths, text
from codelode.operators import resolve, rules, search
from codelode.plans.registry import query
from codelode.sources import store, views
from codelode.sources.fulltext import FullText
from codelode.sources.views import EDGES, FILES, LINES, SYMBOLS

WITH = "WITH "


@query(WITH + EDGES + " SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM edges) AS n_edges")
def store_counts(spark, d):
    one = [views.files(spark, d).agg(F.count("*").alias("n_files")), views.symbols(spark, d).agg(F.count("*").alias("n_symbols")), views.edges(spark, d).agg(F.count("*").alias("n_edges"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))  # one row each


@query(WITH + SYMBOLS + " SELECT lang, count(*) AS n FROM symbols GROUP BY lang")
def lang_histogram(spark, d):
    return views.symbols(spark, d).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query(WITH + EDGES + " SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def relation_histogram(spark, d):
    return views.edges(spark, d).groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")


@query(WITH + FILES + " SELECT ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ext")
def shape_by_ext(spark, d):
    return views.files(spark, d).groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(WITH + FILES + " SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM files GROUP BY 1")
def shape_by_topdir(spark, d):
    return views.files(spark, d).groupBy(paths.top_dir(F.col("path")).alias("top")).agg(F.count("*").alias("n"))


def _index(spark, d):
    """The stored full-text index of the documents as files, made by the first query that asks for it."""
    index = FullText(spark, scratch.stamped(spark, "fulltext", f"{d}/documents.parquet"))
    if not index.generations:
        index.put(views.files(spark, d))
    return index


def _has(term):
    return f"(contains(lower(content), '{term}') OR contains(lower(path), '{term}'))"


@query(WITH + FILES + f" SELECT id, path FROM files WHERE {_has('license')}")
def fts_single(spark, d):
    return _index(spark, d).match(views.files(spark, d), "license").select("id", "path")


@query(WITH + FILES + f" SELECT id, path FROM files WHERE {_has('the')} AND {_has('tion of')}")
def fts_and(spark, d):
    return _index(spark, d).match(views.files(spark, d), 'the "tion of"').select("id", "path")


@query(WITH + FILES + f" SELECT id, path FROM files WHERE {_has('apache')} OR ({_has('gnu')} AND {_has('version')})")
def fts_or(spark, d):
    return _index(spark, d).match(views.files(spark, d), "apache OR gnu version").select("id", "path")


@query(WITH + FILES + f" SELECT id, path FROM files WHERE ext = '.fr' AND {_has('licensed')}")
def fts_ext_filter(spark, d):
    return _index(spark, d).match(views.files(spark, d).where("ext = '.fr'"), "licensed").select("id", "path")


@query(WITH + FILES + f" SELECT id, path FROM files WHERE {_has('licensed')} AND NOT ({_has('apache')} OR {_has('mit license')})")
def fts_not(spark, d):
    return _index(spark, d).match(views.files(spark, d), 'licensed NOT (apache OR "mit license")').select("id", "path")


@query(
    WITH + FILES + """, t AS (SELECT id, path, greatest(length(path) - 2, 0) + greatest(length(content) - 2, 0) AS len, lower(path || chr(10) || content) AS low FROM files),
u AS (SELECT id, path, len, (length(low) - length(replace(low, 'licensed', ''))) / 8.0 AS a, (length(low) - length(replace(low, 'version', ''))) / 7.0 AS b FROM t),
s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM u)
SELECT id, path, round(-(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al))), 6) AS rank
FROM u, s WHERE a > 0 AND b > 0"""
)
def fts_rank(spark, d):
    """All matches of two terms with their rank, from the stored index."""
    return _index(spark, d).ranked(views.files(spark, d), "licensed version").select("id", "path", F.round("rank", 6).alias("rank"))

@query(
    WITH + FILES + """, t AS (SELECT id, path, length(content) AS len, (length(lower(content)) - length(replace(lower(content), 'licensed', ''))) / 8.0 AS a,
 (length(lower(content)) - length(replace(lower(content), 'version', ''))) / 7.0 AS b FROM files),
s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t)
SELECT id, path, round(-(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al))), 6) AS rank
FROM t, s WHERE a > 0 OR b > 0 ORDER BY rank, path LIMIT 20"""
)
def fts_rank_topk(spark, d):
    return search.rank(views.files(spark, d), ["licensed", "version"], 20)


@query(WITH + SYMBOLS + " SELECT id, name, kind, path FROM symbols WHERE name ILIKE '%Tion%' ORDER BY path, id LIMIT 25")
def symbol_like(spark, d):
    return search.symbols_like(views.symbols(spark, d), "%Tion%", 25).select("id", "name", "kind", "path")


@query(WITH + SYMBOLS + " SELECT id, name, kind, path FROM symbols WHERE name = 'The' AND kind IN ('class', 'method') ORDER BY path, id LIMIT 500")
def symbol_exact_kinds(spark, d):
    return search.symbols_named(views.symbols(spark, d), "The", ["class", "method"]).select("id", "name", "kind", "path")


@query(WITH + SYMBOLS + " SELECT id, name, kind, path FROM symbols WHERE name = 'The' AND kind IN ('class', 'method')")
def symbol_exact_kinds_all(spark, d):
    return search.symbols_named(views.symbols(spark, d), "The", ["class", "method"], None).select("id", "name", "kind", "path")


@query(WITH + SYMBOLS + " SELECT s.id, decode(array_slice(encode(f.content), s.start_byte + 1, s.end_byte)) AS span FROM symbols s JOIN files f ON f.id = s.file_id")
def slice_bytes_span(spark, d):
    s, f = views.symbols(spark, d), views.files(spark, d).select(F.col("id").alias("file_id"), "content")
    return s.join(f, "file_id").select("id", text.slice_bytes(F.col("content"), F.col("start_byte"), F.col("end_byte") - F.col("start_byte")).alias("span"))


@query(WITH + EDGES + ", d AS (SELECT name, min(id) AS id FROM symbols GROUP BY name) SELECT e.id, s.name AS src_name, e.relation, coalesce(d.name, e.dst_name) AS dst, d.id AS dst_id FROM edges e JOIN symbols s ON s.id = e.src_symbol_id LEFT JOIN d ON d.name = e.dst_name")
def edge_inspect(spark, d):
    s, e = views.symbols(spark, d), views.edges(spark, d)
    first = s.groupBy(F.col("name").alias("dst_name")).agg(F.min("id").alias("dst_id"))
    j = e.join(s.select(F.col("id").alias("src_symbol_id"), F.col("name").alias("src_name")), "src_symbol_id").join(first, "dst_name", "left")
    return j.select("id", "src_name", "relation", F.col("dst_name").alias("dst"), "dst_id")


@query(WITH + SYMBOLS + " SELECT s.id, CASE WHEN p.id IS NULL THEN s.name ELSE p.name || '::' || s.name END AS qualified FROM symbols s LEFT JOIN symbols p ON p.id = s.parent_id")
def qualified_name(spark, d):
    return resolve.qualified_names(views.symbols(spark, d))


@query(WITH + FILES + """ SELECT id, regexp_replace(regexp_replace(coalesce(content, ''), chr(9), '    ', 'g'), '\\r\\n|\\n|\\r', ' ', 'g') AS cell FROM files""")
def tsv_cells(spark, d):
    return views.files(spark, d).select("id", text.tsv_cell(F.col("content")).alias("cell"))


@query(
    WITH + FILES + """, l AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'src' || (event_id % 20) || '/en' WHEN event_id % 3 = 1 THEN 'doc' || (event_id % 900) || '.' ELSE 'src1/en/doc' || (event_id % 900) || '.en' END AS core FROM events WHERE event_id < 60),
x AS (SELECT l.id, f.path FROM l JOIN files f ON f.path = l.core)
SELECT DISTINCT * FROM (SELECT * FROM x UNION ALL SELECT l.id, f.path FROM l JOIN files f ON contains(f.path, l.core) WHERE l.id NOT IN (SELECT id FROM x))"""
)
def referenced_paths(spark, d):
    return search.referenced_paths(_log(views.read(spark, d, "events").where("event_id < 60")), views.files(spark, d))


def _log(events):
    """A statement log: a statement an event, with one quoted literal."""
    n = F.col("event_id")
    core = F.when(n % 3 == 0, F.concat(F.lit("src"), (n % 20).cast("string"), F.lit("/en"))).when(n % 3 == 1, F.concat(F.lit("doc"), (n % 900).cast("string"), F.lit("."))).otherwise(F.concat(F.lit("src1/en/doc"), (n % 900).cast("string"), F.lit(".en")))
    return events.select(n.alias("id"), F.concat(F.lit("SELECT * FROM files WHERE path LIKE '%"), core, F.lit("%'")).alias("sql_text"))


@query(
    WITH + FILES + """, l AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'src' || (event_id % 20) || '/en' WHEN event_id % 3 = 1 THEN 'doc' || (event_id % 900) || '.' ELSE 'src1/en/doc' || (event_id % 900) || '.en' END AS core FROM events),
c AS (SELECT DISTINCT core FROM l), x AS (SELECT c.core, f.path FROM c JOIN files f ON f.path = c.core),
n AS (SELECT * FROM x UNION SELECT c.core, f.path FROM c JOIN files f ON contains(f.path, c.core) WHERE c.core NOT IN (SELECT core FROM x))
SELECT DISTINCT l.id, n.path FROM l JOIN n ON n.core = l.core"""
)
def referenced_paths_all(spark, d):
    return search.referenced_paths(_log(views.read(spark, d, "events")), views.files(spark, d))


WORDS = r", code AS (SELECT file_id, path, pos, regexp_replace(split_part(line, ' ', 1), '[^A-Za-z]', '', 'g') AS a, regexp_replace(split_part(line, ' ', 2), '[^A-Za-z]', '', 'g') AS b FROM lines)"


def _code(spark, d):
    """Import lines of Python and C made of each line's first two words."""
    l = views.lines(spark, d)
    word = lambda n: F.regexp_replace(F.coalesce(F.try_element_at(F.split("line", " "), F.lit(n)), F.lit("")), "[^A-Za-z]", "")
    l = l.select("file_id", "path", "pos", word(1).alias("a"), word(2).alias("b"))
    line = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("import "), "a", F.when(F.col("b") != "", F.concat(F.lit(", "), "b", F.lit(" as z"))).otherwise(""))).when(F.col("pos") % 3 == 1, F.concat(F.lit("from "), "a", F.lit("."), "b", F.lit(" import x"))).otherwise(F.concat(F.lit('#include "'), "a", F.lit("/"), "b", F.lit('.h"')))
    return l.select("file_id", "path", "pos", F.when(F.col("pos") % 3 == 2, "c").otherwise("python").alias("lang"), line.alias("line"))


IMPORTS = WORDS + """, imports AS (SELECT file_id, path, pos + 1 AS line, 'import' AS kind, unnest([a, b]) AS target FROM code WHERE pos % 3 = 0
UNION ALL SELECT file_id, path, pos + 1, 'import_from', a || '.' || b FROM code WHERE pos % 3 = 1
UNION ALL SELECT file_id, path, pos + 1, 'include', a || '/' || b || '.h' FROM code WHERE pos % 3 = 2)"""


@query(WITH + LINES + IMPORTS + " SELECT file_id, CAST(line AS BIGINT) AS line, kind, target FROM imports WHERE target <> ''")
def import_extract(spark, d):
    return resolve.extract_imports(_code(spark, d)).withColumn("line", F.col("line").cast("long"))


@query(
    WITH + LINES + """, im AS (SELECT DISTINCT id AS file_id, path, CAST(1 AS BIGINT) AS line, 'sub/doc' || (id % 97) || '.en' AS target FROM files),
c AS (SELECT file_id, line, target, 0 AS ord, regexp_replace(path, '/[^/]*$', '') || '/' || target AS cand FROM im UNION ALL SELECT file_id, line, target, 1, target FROM im),
h AS (SELECT c.*, f.id AS dst, f.path AS dp, CASE WHEN f.path = cand THEN 1 WHEN ends_with(f.path, '/' || cand) THEN 2 ELSE 3 END AS stage FROM c JOIN files f ON split_part(f.path, '/', -1) = split_part(cand, '/', -1)),
r AS (SELECT file_id, line, target, dst, row_number() OVER (PARTITION BY file_id, line, target ORDER BY stage, CASE WHEN stage = 3 THEN 0 ELSE ord END, length(dp), dp, dst) AS k FROM h)
SELECT im.file_id, im.line, im.target, r.dst AS dst_file_id FROM im LEFT JOIN r ON r.file_id = im.file_id AND r.k = 1"""
)
def import_resolve(spark, d):
    f = views.files(spark, d)
    target = F.concat(F.lit("sub/doc"), (F.col("id") % 97).cast("string"), F.lit(".en"))
    imports = f.select(F.col("id").alias("file_id"), "path", F.lit(1).cast("long").alias("line"), F.lit("include").alias("kind"), target.alias("target"))
    return resolve.resolve_imports(imports, f.select("id", "path"))


CANDIDATES = """, per AS (SELECT name, count(*) AS n, bool_or(end_byte - start_byte > length(name) + 16) AS anyd FROM symbols GROUP BY name),
def AS (SELECT s.* FROM symbols s JOIN per USING (name) WHERE n = 1 OR NOT anyd OR end_byte - start_byte > length(name) + 16)"""


@query(
    WITH + EDGES + CANDIDATES + """, cand AS (SELECT name, count(*) AS n, min(id) AS only FROM def GROUP BY name)
SELECT e.id, e.dst_name, CASE WHEN c.n IS NULL THEN 'unresolved' WHEN c.n = 1 THEN 'unique' ELSE 'ambiguous' END AS confidence, coalesce(c.n, 0) AS ambiguity,
 CASE WHEN c.n = 1 THEN c.only END AS target_id FROM edges e LEFT JOIN cand c ON c.name = e.dst_name"""
)
def name_resolution_confidence(spark, d):
    return resolve.resolve(views.edges(spark, d), views.symbols(spark, d)).select("id", "dst_name", "confidence", "ambiguity", "target_id")


@query(WITH + SYMBOLS + CANDIDATES + " SELECT id, name FROM def")
def definition_preference(spark, d):
    return resolve.definitions(views.symbols(spark, d)).select("id", "name")


def _seed_sql(seed: str) -> str:
    low = seed.lower()
    return WITH + SYMBOLS + f""", a AS (SELECT id, path, 1 AS stage FROM files WHERE path = '{seed}' OR ends_with(path, '/{seed}')
UNION ALL SELECT DISTINCT file_id, path, 2 FROM symbols WHERE name = '{seed}' UNION ALL SELECT DISTINCT file_id, path, 3 FROM symbols WHERE name ILIKE '%{seed}%'
UNION ALL SELECT id, path, 4 FROM files WHERE contains(lower(content), '{low}') OR contains(lower(path), '{low}'))
SELECT id, path, stage FROM a WHERE stage = (SELECT min(stage) FROM a) ORDER BY length(path) * (stage = 1)::INTEGER, path LIMIT 25"""


@query(_seed_sql("doc7.en"))
def file_seed_stages(spark, d):
    """Found by the end of a path, or by text where there is no such path."""
    return search.staged_seeds(views.files(spark, d), views.symbols(spark, d), "doc7.en")


@query(_seed_sql("tionea"))
def file_seed_by_symbol(spark, d):
    """No path ends in this and no symbol is named so, but symbols have it in their names."""
    return search.staged_seeds(views.files(spark, d), views.symbols(spark, d), "tionea")


RULES = [
    {"id": "drop-the", "action": "drop", "when": {"name_regex": "The"}},
    {"id": "methods-of-fr", "action": "reclassify", "kind_to": "function", "when": {"lang": "fr", "kind": "method"}},
    {"id": "mark-functions", "action": "set_attr", "attrs": {"role": "f"}, "when": {"kind": "function", "path_glob": "src1*"}},
]
RULED = """, ruled AS (SELECT id, name, CASE WHEN lang = 'fr' AND kind = 'method' THEN 'function' ELSE kind END AS kind, path, lang = 'fr' AND kind = 'method' AS r2 FROM symbols WHERE name <> 'The'),
rr AS (SELECT *, kind = 'function' AND path LIKE 'src1%' AS r3 FROM ruled)"""


def _ruled(spark, d):
    s = views.symbols(spark, d)
    s = s.withColumn("attrs", F.lit(None).cast("map<string,string>")).withColumn("provenance", F.lit(None).cast("array<string>"))
    return s, rules.apply(s, RULES)


@query(WITH + SYMBOLS + RULED + " SELECT id, name, kind, CASE WHEN r3 THEN 'f' END AS role, concat_ws(',', CASE WHEN r2 THEN 'methods-of-fr' END, CASE WHEN r3 THEN 'mark-functions' END) AS provenance FROM rr")
def rules_apply(spark, d):
    _, out = _ruled(spark, d)
    return out.select("id", "name", "kind", F.try_element_at("attrs", F.lit("role")).alias("role"), F.array_join(F.coalesce("provenance", F.array().cast("array<string>")), ",").alias("provenance"))


@query(
    WITH + SYMBOLS + """ SELECT id, CASE WHEN name = 'The' THEN 'drop ' || kind || ' ' || name ELSE kind || ' ' || name || ' -> function ' || name END AS change
FROM symbols WHERE name = 'The' OR (lang = 'fr' AND kind = 'method')"""
)
def rules_preview_diff(spark, d):
    return rules.preview(*_ruled(spark, d))


@query(
    WITH + LINES + """, sp AS (SELECT DISTINCT file_id, CAST(pos + 1 AS BIGINT) AS f, CAST(pos + 2 AS BIGINT) AS l, CASE WHEN pos % 8 = 0 THEN 'defined(KEEP_ME)' ELSE 'OTHER_' || pos END AS c FROM lines WHERE pos % 4 = 0)
SELECT l.file_id, CAST(l.pos + 1 AS BIGINT) AS line_no, l.line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.file_id = l.file_id AND l.pos + 1 BETWEEN sp.f AND sp.l AND NOT contains(sp.c, 'KEEP_ME'))"""
)
def ifdef_prune(spark, d):
    l = views.lines(spark, d)
    numbered = l.select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    cond = F.when(F.col("pos") % 8 == 0, F.lit("defined(KEEP_ME)")).otherwise(F.concat(F.lit("OTHER_"), F.col("pos").cast("string")))
    spans = l.where("pos % 4 = 0").select("file_id", (F.col("pos") + 1).cast("long").alias("first"), (F.col("pos") + 2).cast("long").alias("last"), cond.alias("condition"))
    return rules.prune_ifdef(numbered, spans, ["KEEP_ME"])


@query(WITH + SYMBOLS + " SELECT id, file_id, name FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY start_byte, end_byte) AS k FROM symbols) WHERE k > 1")
def dup_ids(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file_id", "name").orderBy("start_byte", "end_byte")
    return views.symbols(spark, d).withColumn("k", F.row_number().over(w)).where("k > 1").select("id", "file_id", "name")


@query(WITH + EDGES + " SELECT e.id, e.dst_name FROM edges e WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = e.file_id AND s.name = e.dst_name)")
def dangling_refs(spark, d):
    e, s = views.edges(spark, d), views.symbols(spark, d)
    return e.join(s.select("file_id", F.col("name").alias("dst_name")), ["file_id", "dst_name"], "left_anti").select("id", "dst_name")


@query(
    WITH + SYMBOLS + """, p AS (SELECT DISTINCT file_id, name FROM symbols), want AS (SELECT unnest(['The', 'Of', 'And']) AS pin)
SELECT f.id AS file_id, want.pin FROM files f, want WHERE f.ext = '.en' AND NOT EXISTS (SELECT 1 FROM p WHERE p.file_id = f.id AND p.name = want.pin)"""
)
def required_pins(spark, d):
    have = views.symbols(spark, d).select("file_id", F.col("name").alias("pin")).distinct()
    want = views.files(spark, d).where("ext = '.en'").select(F.col("id").alias("file_id"), F.explode(F.array(*map(F.lit, ("The", "Of", "And")))).alias("pin"))
    return want.join(have, ["file_id", "pin"], "left_anti")


LINKS = """WITH code AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'A' WHEN 2 THEN 'F' ELSE '' END || 'Part' || (p_partkey % 300) AS name, CAST(p_size % 2 * 100 AS BIGINT) AS len FROM part),
n AS (SELECT s_suppkey AS id, 'type' || s_suppkey AS node_type, CASE WHEN s_suppkey % 5 <> 0 THEN 'Part' || (s_suppkey * 7 % 400) END AS cls FROM supplier),
t AS (SELECT n.id, o AS ord, ['U', 'A', 'F', ''][o + 1] AS prefix, ['U', 'A', 'F', ''][o + 1] || cls AS name FROM n, (SELECT unnest([0, 1, 2, 3]) AS o) WHERE cls IS NOT NULL),
h AS (SELECT t.*, c.len > length(t.name) + 16 AS isd FROM t JOIN code c USING (name)),
b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, bool_or(isd) OVER (PARTITION BY id) AS anyd FROM (SELECT *, min(ord) OVER (PARTITION BY id) AS mo FROM h) WHERE ord = mo),
g AS (SELECT id, count(*) AS candidates, min(prefix) AS prefix FROM b WHERE n = 1 OR NOT anyd OR isd GROUP BY id)
SELECT n.id, n.node_type, CASE WHEN cls IS NULL THEN 'no-classPath' WHEN candidates IS NULL THEN 'unresolved' WHEN candidates = 1 THEN 'unique' ELSE 'ambiguous' END AS status, prefix, coalesce(candidates, 0) AS candidates
FROM n LEFT JOIN g USING (id)"""


@query(LINKS)
def link_source_prefix_priority(spark, d):
    from codelode.operators import dsl

    p, s = views.read(spark, d, "part"), views.read(spark, d, "supplier")
    k = F.col("p_partkey")
    pre = F.when(k % 4 == 0, "U").when(k % 4 == 1, "A").when(k % 4 == 2, "F").otherwise("")
    code = p.select(k.alias("id"), F.concat(pre, F.lit("Part"), (k % 300).cast("string")).alias("name"), F.lit("class").alias("kind"), F.lit(0).alias("start_byte"), (F.col("p_size") % 2 * 100).alias("end_byte"))
    n = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("type"), F.col("s_suppkey").cast("string")).alias("node_type"))
    schema = s.select(F.concat(F.lit("type"), F.col("s_suppkey").cast("string")).alias("node_type"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("/Script/Engine.Part"), (F.col("s_suppkey") * 7 % 400).cast("string"))).alias("class_path"))
    return dsl.link_classes(n, schema, code)


@query(
    "SELECT count(*) FILTER (status = 'unique') AS resolved_unique, count(*) FILTER (status = 'ambiguous') AS resolved_ambiguous, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'no-classPath') AS no_class_path, count(*) AS total FROM (" + LINKS + ")"
)
def link_summary(spark, d):
    from codelode.operators import dsl

    return dsl.link_summary(link_source_prefix_priority(spark, d))


@query(
    WITH + FILES + """ SELECT id, substr(sha1('{"direction": "out", "fp": "' || size || '", "max_depth": 3, "max_nodes": 200, "seed": "' || path || '"}'), 1, 16) AS cache_key FROM files"""
)
def cache_key(spark, d):
    f = views.files(spark, d)
    doc = F.concat(F.lit('{"direction": "out", "fp": "'), F.col("size").cast("string"), F.lit('", "max_depth": 3, "max_nodes": 200, "seed": "'), "path", F.lit('"}'))
    return f.select("id", F.substring(F.sha1(doc), 1, 16).alias("cache_key"))


@query(
    WITH + FILES + """ SELECT id, rtrim(ltrim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-'), '-') AS slug, regexp_replace(path, '/[^/]*$', '') AS parent,
 'n_' || regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') AS mermaid, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS line FROM files"""
)
def text_functions(spark, d):
    f = views.files(spark, d)
    return f.select("id", text.slugify(F.col("path")).alias("slug"), paths.parent_dir(F.col("path")).alias("parent"), text.mermaid_id(F.col("path")).alias("mermaid"), text.one_line(F.col("content")).alias("line"))


@query("SELECT key, max_by(value, n) AS value FROM (SELECT source AS key, lang AS value, doc_id AS n FROM documents) GROUP BY key")
def meta_upsert(spark, d):
    docs = views.read(spark, d, "documents")
    last = docs.groupBy("source").agg(F.max("doc_id").alias("m"))
    rows = docs.select(F.col("source").alias("key"), F.col("lang").alias("value"), "doc_id").join(last.withColumnRenamed("source", "key"), "key")
    old = rows.where("doc_id <> m").groupBy("key").agg(F.max_by("value", "doc_id").alias("value"))
    return store.upsert_meta(old, rows.where("doc_id = m").select("key", "value"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 <> doc_id % 2 THEN 1 ELSE 0 END AS n FROM documents")
def dsl_equiv(spark, d):
    from codelode.operators import dsl

    docs = views.read(spark, d, "documents")
    a = F.concat(F.lit("(m :k "), (F.col("doc_id") % 3).cast("string"), F.lit(" :j 2.0 (x y)) ; left"))
    b = F.concat(F.lit("(m :j 4/2 (x y) :k "), (F.col("doc_id") % 2).cast("string"), F.lit(")"))
    return docs.select(F.col("doc_id").alias("id"), a.alias("a"), b.alias("b")).select("id", dsl.n_differences("a", "b").alias("n"))


@query(
    """SELECT doc_id AS id, 'dangling-ref' AS code, 1 AS line FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'duplicate-id', 1 FROM documents WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 'unclosed-list', 1 FROM documents WHERE doc_id % 4 = 3"""
)
def dsl_validate(spark, d):
    from codelode.operators import dsl

    docs = views.read(spark, d, "documents")
    tail = F.element_at(F.array(*map(F.lit, ("(ref a))", "(ref z))", ") (node a add)", "(ref a)"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text_ = F.concat(F.lit("(material m) (outputs o) (node a add) (node b add "), tail)
    return dsl.validate_files(docs.select(F.col("doc_id").alias("id"), text_.alias("content")), "matlang").select("id", "code", F.col("line").cast("int").alias("line"))
