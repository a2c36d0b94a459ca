"""Path and glob expressions, as columns and (where the scanner needs them) in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_extension(path: Column) -> Column:
    """Dotted extension of the file name, empty without one; a leading dot starts no extension."""
    return F.regexp_extract(path, r"[^/.][^/]*([.][^./]*)$", 1)


def relative_path(path: Column, root: Column | str) -> Column:
    """``path`` below ``root``, or unchanged where it isn't below it."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def store_key(path: Column) -> Column:
    """Folder name of a codebase's store: 16 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def glob_regex(glob: str, star: str = ".*") -> str:
    """Regular expression of a glob in which only ``*`` is special."""
    return star.join(re.escape(part) for part in glob.split("*"))


def ignore_regex(pattern: str) -> str | None:
    """Regular expression, found in a relative path, of an ignore pattern.

    A pattern with a slash inside matches the path or a folder above it from the
    root on; one without, any component; a slash at its end changes nothing, as a
    path below a matching folder is ignored too.
    """
    body = pattern.strip("/")
    if not body:
        return None
    if "/" in body:
        return f"^{glob_regex(body)}(/.*)?$"
    return f"(^|/){glob_regex(body, '[^/]*')}(/|$)"


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_ignored(path: Column, patterns) -> Column:
    """Hidden paths and those that a pattern matches."""
    found = is_hidden(path)
    for regex in filter(None, map(ignore_regex, patterns)):
        found = found | path.rlike(regex)
    return found
