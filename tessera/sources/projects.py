"""Projects: keys of repositories, and the stack of libraries that a folder sees."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What marks the top of a project, and where its own library lies.
MARKERS = (".git", "package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", ".tessera")
OWN_LIBRARY = ".tessera"


def project_key(remote: Column) -> Column:
    """``host/owner/name`` of a repository's address, of whatever form; null without one."""
    plain = F.regexp_replace(F.trim(remote), r"\.git$", "")
    ssh = F.regexp_replace(plain, r"^git@([^:]+):(.+)$", "$1/$2")
    web = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?", ""), r"/+$", "")
    return F.nullif(F.when(F.startswith(plain, F.lit("git@")), ssh).otherwise(web), F.lit(""))


def hashed(project: Column, module: Column) -> dict[str, Column]:
    """What a log may say of a project."""
    return {"has_project": F.coalesce(project != "", F.lit(False)), "project_hash": F.sha2(project, 256), "module_hash": F.sha2(module, 256)}


def context(cwd: str | None) -> dict:
    """Project of a folder (driver side): its root, key (its package name, or its folder's) and the module within it."""
    none = {"root": None, "project_key": None, "module_path": None, "source": "none"}
    at = os.path.abspath(cwd) if cwd else None
    if at is None:
        return none
    root = at
    while not any(os.path.exists(os.path.join(root, m)) for m in MARKERS):
        up = os.path.dirname(root)
        if up == root:
            return none
        root = up
    try:
        with open(os.path.join(root, "package.json"), encoding="utf-8") as f:
            package = str(json.load(f).get("name") or "").strip()
    except (OSError, ValueError, AttributeError):
        package = ""
    return {"root": root, "project_key": package or os.path.basename(root), "module_path": os.path.relpath(at, root), "source": "package" if package else "path"}


def library_stack(home: str, cwd: str | None) -> list[tuple[str, str]]:
    """(scope, folder) of the libraries that a folder sees: the global one, then its project's."""
    root = context(cwd)["root"]
    own = os.path.join(root, OWN_LIBRARY) if root else None
    return [("global", home)] + ([("project", own)] if own and os.path.abspath(own) != os.path.abspath(home) else [])


def read_stack(spark: SparkSession, stack: list[tuple[str, str]], read) -> tuple[DataFrame | None, list[str]]:
    """Cards of all libraries with their ``library_scope`` and ``library_path``, and a warning for each that cannot be read."""
    out, warnings = None, []
    for scope, folder in stack:
        try:
            part = read(spark, folder).withColumns({"library_scope": F.lit(scope), "library_path": F.lit(folder)})
            part.limit(1).count()
        except Exception as e:
            warnings.append(f"{scope}: {type(e).__name__}")
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, warnings
