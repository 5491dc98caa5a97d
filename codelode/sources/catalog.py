"""Stores on shared storage: their settings, a catalog of them, and the files they stand for.

A store is a folder of tables; what is said about it are rows of its table ``settings``. A catalog is an append-only
table of what became of stores. Both are read through Spark and the Hadoop file system, so a store may lie
wherever the cluster can read, and the newest row of a key counts, so writers never rewrite what others wrote.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "layer string, name string, value string, at long, serial string"
ENTRIES = "store string, alias string, root string, alive boolean, at long, serial string"
FOLDER = ".codelode"
VARIABLE = "CODELODE_STORE"
LAYERS = ("shared", "user")  # later ones win
# File name extensions by language.
EXTENSIONS = {
    "cpp": [".h", ".hpp", ".hh", ".inl", ".ipp", ".c", ".cc", ".cpp", ".cxx"],
    "python": [".py", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "csharp": [".cs"],
    "java": [".java"],
    "gdscript": [".gd"],
    "shader": [".hlsl", ".usf", ".ush"],
    "glsl": [".glsl", ".vert", ".frag", ".comp", ".geom", ".tesc", ".tese"],
    "docs": [".md", ".json", ".ini"],
}
# Paths that are ignored where the settings say nothing.
IGNORE = ("ThirdParty/*", "Intermediate/*", "*/node_modules/*")
# Folders right below a home folder that are no place for a store.
SHELL_FOLDERS = ("desktop", "documents", "downloads", "onedrive")


class NoStore(LookupError):
    pass


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as stores are named in a catalog."""
    return _hadoop(spark, path)[1].toString()


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, p = _hadoop(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    now = time.time_ns()
    spark.createDataFrame([(*r, now, uuid.uuid4().hex) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


# settings of a store


def put(spark: SparkSession, store: str, layer: str = "shared", **values) -> None:
    """Say something about a store; None takes a setting back."""
    if layer not in LAYERS:
        raise ValueError(f"a layer is one of {LAYERS}")
    _append(spark, f"{store}/settings", [(layer, k, json.dumps(v)) for k, v in values.items()], SETTINGS)


def settings(spark: SparkSession, store: str) -> dict:
    """What holds for a store: the newest row of every setting, the user's before the shared one, and what follows from them."""
    said = _rows(spark, f"{store}/settings", SETTINGS).withColumn("rank", F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")))
    newest = said.groupBy("rank", "name").agg(F.max_by("value", F.struct("at", "serial")).alias("value")).where("value <> 'null'")
    known = {r.name: json.loads(r.value) for r in newest.groupBy("name").agg(F.max_by("value", "rank").alias("value")).collect()}  # a few settings
    out = {"alias": store.rstrip("/").removesuffix(FOLDER).rstrip("/").rpartition("/")[2], "languages": [], "ignore": list(IGNORE), "profile": None, "extensions": None, "root": store.rstrip("/").rpartition("/")[0]} | known
    if not out.get("exts"):
        out["exts"] = list(dict.fromkeys(e for x in out["languages"] for e in EXTENSIONS.get(x.lower(), ())))
    return out


def is_store(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "settings"))


def init(spark: SparkSession, location: str, **values) -> str:
    """The store of a location, made with these settings unless it is there already."""
    store = f"{qualified(spark, location)}/{FOLDER}"
    if not is_store(spark, store):
        put(spark, store, **{"languages": [], **values})
    return store


def active_extensions(spark: SparkSession, store: str, marks: dict[str, str]) -> list[str]:
    """Extensions the settings list (an empty list turns all off), the one their profile names, or those whose marker
    file, by marks {extension: pattern}, lies in the root or beside the store."""
    s = settings(spark, store)
    if s["extensions"] is not None:
        return s["extensions"]
    if s["profile"] in marks:
        return [s["profile"]]
    places = {s["root"], store.rstrip("/").rpartition("/")[0]}

    def marked(pattern: str) -> bool:
        return any(fs.globStatus(p) for fs, p in (_hadoop(spark, f"{place}/{pattern}") for place in places))

    return [name for name, pattern in marks.items() if marked(pattern)]


# finding stores


def nearest(spark: SparkSession, start: str = ".") -> str | None:
    """The store the environment names, or the one of the folder start, or of the nearest folder above that has one."""
    named = os.environ.get(VARIABLE)
    if named is not None:
        return qualified(spark, named) if is_store(spark, named) else None
    fs, at = _hadoop(spark, start)
    while at is not None:
        here = at.toString()
        inside = here + FOLDER if here.endswith("/") else f"{here}/{FOLDER}"
        for store in (inside, here):
            if is_store(spark, store):
                return store
        at = at.getParent()
    return None


class Catalog:
    """Which stores there are, as rows appended to one table; a store's newest row counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stores(self) -> DataFrame:
        """(store, alias, root, at) of the stores that have not been taken out."""
        new = _rows(self.spark, self.path, ENTRIES).groupBy("store").agg(F.max_by(F.struct("alias", "root", "alive"), F.struct("at", "serial")).alias("e"), F.max("at").alias("at"))
        return new.where("e.alive").select("store", "e.alias", "e.root", "at")

    def add(self, store: str, alias: str | None = None, root: str | None = None) -> None:
        said = settings(self.spark, store)
        _append(self.spark, self.path, [(qualified(self.spark, store), alias or said["alias"], root or said["root"], True)], ENTRIES)

    def remove(self, store: str) -> bool:
        """Take a store out of the catalog; its tables stay. Whether it was in."""
        name = qualified(self.spark, store)
        known = bool(self.stores().where(F.col("store") == name).take(1))
        if known:
            _append(self.spark, self.path, [(name, None, None, False)], ENTRIES)
        return known

    def named(self, alias: str) -> str | None:
        """The store of an alias, the one added last if several share it."""
        r = self.stores().where(F.col("alias") == alias).orderBy(F.desc("at"), "store").first()
        return r.store if r else None


def resolve(spark: SparkSession, name: str | None = None, start: str = ".", catalog: Catalog | None = None) -> str:
    """A store by its path, by the folder it lies in, or by its alias; without a name the nearest one."""
    if name is None:
        found = nearest(spark, start)
    elif is_store(spark, name):
        found = qualified(spark, name)
    elif is_store(spark, f"{name}/{FOLDER}"):
        found = f"{qualified(spark, name)}/{FOLDER}"
    else:
        found = catalog.named(name) if catalog else None
    if found is None:
        raise NoStore(f"no store {name or 'here'}; make one with init() or name it in {VARIABLE}")
    return found


def unsuitable(path: str, home: str | None = None) -> bool:
    """Whether a folder is the top of a file system, a home folder or a shell folder of one, where no store should lie."""
    home = os.path.realpath(home or os.path.expanduser("~"))
    path = os.path.realpath(path)
    above, last = os.path.split(path)
    return not last or path == home or above == home and last.lower() in SHELL_FOLDERS


def file_state(spark: SparkSession, names: DataFrame, root: str) -> DataFrame:
    """names(path, ...) with mtime (seconds) and size of the files under root as they are now; nulls where there is none.

    Files are listed by Spark, whose readers pass over empty files, so these count as not there; content is not read.
    """
    base = qualified(spark, root).rstrip("/")
    here = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.replace(F.col("path"), F.lit(base), F.lit("")), "^(file:)?/+", "")
    state = here.select(inside.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return names.join(state, "path", "left")
