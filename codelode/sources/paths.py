"""Which files of a tree are indexed: ignored folders, suffixes, and patterns of ignore files."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders and suffixes that are not indexed, and what is kept of the one hidden folder that is.
IGNORED_NAMES = (
    "node_modules", "vendor", "venv", ".venv", "env", ".env", "__pycache__", ".tox", ".pytest_cache", ".mypy_cache", "target", "dist", "build",
    ".next", ".nuxt", ".output", ".git", ".svn", ".hg", ".idea", ".vscode", "coverage",
)
IGNORED_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin",
    ".wasm", ".pyc", ".lock", ".map", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".mov", ".db", ".sqlite", ".sqlite3",
)
KEPT_HIDDEN, KEPT_BELOW = ".github", ("skills", "workflows")
MAX_BYTES = 1_500_000


def pattern(globs: Sequence[str]) -> str | None:
    """One regular expression for the patterns of an ignore file; null for none.

    A trailing slash does not count, * also crosses slashes, there is no negation and no anchor.
    """
    clean = [g.strip().rstrip("/") for g in globs if g.strip() and not g.strip().startswith("#")]
    whole = [fnmatch.translate(g).removesuffix(r"\z").removesuffix(r"\Z") for g in clean if g]
    return "^(?:" + "|".join(whole) + ")$" if whole else None


def ignored(path: Column, globs: Sequence[str] = ()) -> Column:
    """Whether a path is left out of the index; patterns are held against the whole path and against its last part."""
    parts = F.split(path, "/")
    hidden = F.element_at(parts, 1) == KEPT_HIDDEN
    outside = hidden & ~F.coalesce(F.get(parts, F.lit(1)).isin(*KEPT_BELOW), F.lit(False))
    rest = F.when(hidden, F.slice(parts, 2, 1 << 30)).otherwise(parts)
    named = F.exists(rest, lambda p: p.isin(*IGNORED_NAMES) | (p.startswith(".") & ~p.isin(".", "..")))
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)).isin(*IGNORED_SUFFIXES)
    by_file = path.rlike(pattern(globs)) | F.element_at(parts, -1).rlike(pattern(globs)) if pattern(globs) else F.lit(False)
    return F.coalesce(outside | named | suffix | by_file, F.lit(True))


def pruned(folder: str) -> bool:
    """Whether nothing below a folder of the tree (its path from the root) can be indexed, so that it need not be opened."""
    parts = folder.split("/")
    if parts[0] == KEPT_HIDDEN:
        return len(parts) > 1 and (parts[1] not in KEPT_BELOW or any(p in IGNORED_NAMES or p.startswith(".") for p in parts[2:]))
    return any(p in IGNORED_NAMES or p.startswith(".") for p in parts)
