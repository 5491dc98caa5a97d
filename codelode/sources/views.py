"""Engine tables mapped from general tables: documents as files, their lines as symbols and named edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return d.select(F.col("doc_id").alias("id"), path.alias("path"), F.concat(F.lit("."), "lang").alias("ext"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


FILES = """files AS (SELECT doc_id AS id, source || '/' || lang || '/doc' || doc_id || '.' || lang AS path, '.' || lang AS ext,
 octet_length(encode(text)) AS size, text AS content FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, ext, pos, line, start_byte, end_byte) of the non-empty lines."""
    f = files(spark, sf_dir).select("id", "path", "ext", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    f = f.withColumn("start_byte", at).withColumn("end_byte", F.col("start_byte") + F.octet_length("line"))
    return f.where("line <> ''").withColumnRenamed("id", "file_id")


LINES = (
    FILES
    + """, ll AS (SELECT id AS file_id, path, ext, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT *, string_split(content, chr(10)) AS s FROM files)),
lines AS (SELECT * FROM (SELECT *, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
 FROM ll) WHERE line <> '')"""
)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol a line: its first word, a kind by position, its byte span, the class line above as parent."""
    s = lines(spark, sf_dir)
    sid = (F.col("file_id") * 1000000 + F.col("pos")).alias("id")
    kind = F.element_at(F.array(*map(F.lit, ("class", "method", "function"))), F.col("pos") % 3 + 1).alias("kind")
    s = s.select(sid, "file_id", F.substring_index("line", " ", 1).alias("name"), kind, F.substring("ext", 2, 9).alias("lang"), (F.col("pos") + 1).cast("long").alias("start_line"), "start_byte", "end_byte", "path", "line")
    up = Window.partitionBy("file_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("kind") == "class", F.col("id")), ignorenulls=True).over(up)
    return s.withColumn("parent_id", F.when(F.col("kind") != "class", parent))


SYMBOLS = (
    LINES
    + """, sy AS (SELECT file_id * 1000000 + pos AS id, file_id, split_part(line, ' ', 1) AS name, list_extract(['class', 'method', 'function'], CAST(pos % 3 + 1 AS INTEGER)) AS kind,
 substr(ext, 2) AS lang, CAST(pos + 1 AS BIGINT) AS start_line, start_byte, start_byte + octet_length(encode(line)) AS end_byte, path, line FROM lines),
symbols AS (SELECT *, CASE WHEN kind <> 'class' THEN last_value(CASE WHEN kind = 'class' THEN id END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_id FROM sy)"""
)


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol a non-empty line, whose spans nest: every twelfth holds the eleven lines after it, every third the two after it."""
    s = lines(spark, sf_dir)
    by = Window.partitionBy("file_id").orderBy("pos")
    n, reach = F.row_number().over(by) - 1, lambda k: F.last("end_byte").over(by.rowsBetween(Window.currentRow, k))
    s = s.withColumn("n", n).withColumn("e12", reach(11)).withColumn("e3", reach(2))
    kind = F.when(F.col("n") % 12 == 0, "namespace").when(F.col("n") % 3 == 0, "class").otherwise("method")
    end = F.when(F.col("n") % 12 == 0, F.col("e12")).when(F.col("n") % 3 == 0, F.col("e3")).otherwise(F.col("end_byte"))
    name = F.regexp_extract("line", "[A-Za-z_][A-Za-z0-9_]*", 0)
    return s.select((F.col("file_id") * 1000000 + F.col("pos")).alias("id"), "file_id", name.alias("name"), kind.alias("kind"), "start_byte", end.alias("end_byte"))


NESTED = (
    LINES
    + """, nl AS (SELECT *, row_number() OVER w - 1 AS n, last_value(end_byte) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS e12, last_value(end_byte) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS e3
 FROM (SELECT *, start_byte + octet_length(encode(line)) AS end_byte FROM lines) WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
nested AS (SELECT file_id * 1000000 + pos AS id, file_id, regexp_extract(line, '[A-Za-z_][A-Za-z0-9_]*') AS name, CASE WHEN n % 12 = 0 THEN 'namespace' WHEN n % 3 = 0 THEN 'class' ELSE 'method' END AS kind,
 start_byte, CASE WHEN n % 12 = 0 THEN e12 WHEN n % 3 = 0 THEN e3 ELSE end_byte END AS end_byte FROM nl)"""
)

TOKENS = """, tp AS (SELECT file_id, pos, start_byte, generate_subscripts(p, 1) AS k, unnest(p) AS name FROM (SELECT file_id, pos, start_byte, regexp_extract_all(line, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS p FROM lines)),
tokens AS (SELECT file_id, name, CAST(place AS BIGINT) AS place FROM (SELECT *, start_byte + coalesce(sum(octet_length(encode(name))) OVER (PARTITION BY file_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM tp)
 WHERE regexp_matches(name, '^[A-Za-z_]'))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One named edge a line of two words or more: to the second word, in two relations."""
    s = symbols(spark, sf_dir).select("id", "file_id", F.element_at(F.split("line", " "), F.when(F.size(F.split("line", " ")) > 1, 2).otherwise(1)).alias("dst_name"), F.size(F.split("line", " ")).alias("n"), "start_line")
    relation = F.when(F.col("start_line") % 2 == 0, F.lit("extends")).otherwise(F.lit("uses_type")).alias("relation")
    return s.where("n > 1").select("id", "file_id", F.col("id").alias("src_symbol_id"), "dst_name", relation)


EDGES = (
    SYMBOLS
    + """, edges AS (SELECT id, file_id, id AS src_symbol_id, split_part(line, ' ', 2) AS dst_name,
 CASE WHEN start_line % 2 = 0 THEN 'extends' ELSE 'uses_type' END AS relation FROM symbols WHERE contains(line, ' '))"""
)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense graph: supplier nation to customer nation, market segment as relation, lines as weight 1 rows."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.col("c_mktsegment").alias("relation"), F.lit(1).cast("long").alias("weight"))


TRADE = """trade AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, c_mktsegment AS relation, CAST(1 AS BIGINT) AS weight
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def web(spark: SparkSession, sf_dir: str, thin: int = 9) -> DataFrame:
    """A sparse graph on customers that grows with the tables: a share of the orders leads from its customer to another."""
    o = read(spark, sf_dir, "orders").where(f"o_orderkey % {thin} = 5")
    n = read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    dst = ((F.col("o_orderkey") * 7 + 3) % F.col("n")).cast("long").alias("dst")
    return o.crossJoin(F.broadcast(n)).select(F.col("o_custkey").cast("long").alias("src"), dst).where("src <> dst").distinct()  # one row is joined


WEB = """web AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS src, CAST((o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS BIGINT) AS dst FROM orders
 WHERE o_orderkey % 9 = 5 AND o_custkey <> (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer))"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of web with a path-like label and a module: the nation."""
    c, n, r = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("c_custkey").cast("long").alias("id"), F.concat_ws("/", "r_name", "n_name", "c_custkey").alias("label"), F.col("n_nationkey").cast("long").alias("m"), F.col("r_name").alias("module"))


MEMBERS = """members AS (SELECT CAST(c_custkey AS BIGINT) AS id, r_name || '/' || n_name || '/' || c_custkey AS label, CAST(n_nationkey AS BIGINT) AS m, r_name AS module
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse acyclic graph: each turn of a conversation to the turn before."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return c.where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("dst"))


TURNS = "turns AS (SELECT DISTINCT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM conversations WHERE turn > 0)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes with a path-like label and a module: region and nation."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("n_nationkey").cast("long").alias("id"), F.concat("r_name", F.lit("/"), "n_name").alias("label"), F.col("r_name").alias("module"))


NATIONS = """nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id, r_name || '/' || n_name AS label, r_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: static for views, the validity date and a one-file state for the rest."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", F.lit("static")).otherwise(F.lit("dynamic")).alias("kind")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"), F.concat_ws(" ", F.lit("SELECT"), "event_type", "props").alias("sql_text"), kind, F.concat(F.lit("task"), (F.col("event_id") % 7).cast("string")).alias("task_tag"), F.to_date("ts").alias("valid_date"), k.alias("k"))


LOG = """qlog AS (SELECT event_id AS id, CAST(epoch(ts) AS BIGINT) AS ts, 'p' || (user_id % 10) AS project, 'SELECT ' || event_type || ' ' || props AS sql_text,
 CASE WHEN event_type = 'view' THEN 'static' ELSE 'dynamic' END AS kind, 'task' || (event_id % 7) AS task_tag, CAST(ts AS DATE) AS valid_date,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as notes on the log rows with a third and a half of their id."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    status = F.element_at(F.array(*map(F.lit, ("active", "shelved", "cleared"))), (F.col("event_id") % 3 + 1).cast("int")).alias("status")
    return e.select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / (F.col("event_id") % 2 + 2)).alias("log_id"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"), F.lit("check").alias("tag"), status)


NOTES = """notes AS (SELECT event_id AS id, CAST(floor(event_id / (event_id % 2 + 2)) AS BIGINT) AS log_id, 'note ' || event_id AS note, 'check' AS tag,
 list_extract(['active', 'shelved', 'cleared'], CAST(event_id % 3 + 1 AS INTEGER)) AS status FROM events WHERE event_type = 'error')"""
