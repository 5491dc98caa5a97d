"""Path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Forward slashes, leading points and slashes stripped."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^[./]+", "")


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def parent_dir(path: Column, root: str = "(root)") -> Column:
    """Parent folder; root for a path without one."""
    up = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(up.isin("", "."), F.lit(root)).otherwise(up)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; * crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")))) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[:1] == "!" else f"[{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"^(?s:{''.join(out)})$"


def _like(pattern: str):
    return lambda s: s.rlike(pattern)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whole path, folder content, or (for patterns without a slash) any segment."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p)) | path.rlike(glob_regex(p.rstrip("/*") + "/*"))
        if "/" not in p:
            hit = hit | F.exists(F.split(path, "/"), _like(glob_regex(p)))
    return hit


def in_zone(path: Column, root: str) -> Column:
    """Whether a path belongs to the target root; an empty root holds all, a null path belongs to none."""
    root = re.sub(r"^[./]+", "", root.replace("\\", "/")).rstrip("/")
    p = normalise(path)
    return F.when(path.isNull(), F.lit(False)).when(F.lit(root == ""), F.lit(True)).otherwise((p == root) | p.startswith(root + "/"))


# Files that mark the root of a module; *.build.cs and *.uplugin do as well.
BUILD_MARKERS = ("cmakelists.txt", "pyproject.toml", "package.json", "cargo.toml", "go.mod", "setup.py", "build.gradle")


def is_build_marker(path: Column, names: tuple[str, ...] = BUILD_MARKERS) -> Column:
    low = F.lower(base_name(F.translate(path, "\\", "/")))
    return low.isin(*names) | low.endswith(".build.cs") | low.endswith(".uplugin")


def like_prefix(prefix: str) -> str:
    """A LIKE pattern for what begins with prefix, its signs escaped by a backslash."""
    return re.sub(r"([\\%_])", r"\\\1", prefix) + "%"


def dependency_label(path: Column, roots: list[str]) -> Column:
    """<root>::<file name> by the longest root a path is under, else the file name."""
    p = normalise(path)
    out = base_name(p)
    for root in sorted(filter(None, roots), key=len):
        out = F.when((p == root) | p.startswith(root + "/"), F.concat(F.lit(root + "::"), base_name(p))).otherwise(out)
    return out
