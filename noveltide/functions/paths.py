"""Path expressions: slashes of either kind, the stem drops only the last suffix."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def path_suffix(path: Column) -> Column:
    """The last suffix with its dot, lower case; none for names that only start with a dot."""
    return F.lower(F.regexp_extract(path_name(path), r"(?<=.)(\.[^.]+)$", 1))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -2)


def remap_path(path: Column, root: str, prefix: str = "/app/") -> Column:
    """The path with the prefix, where it starts with it, replaced by root; backslashes become slashes."""
    clean = F.translate(path, "\\", "/")
    return F.when(F.startswith(clean, F.lit(prefix)), F.concat(F.lit(root.rstrip("/") + "/"), F.substr(clean, F.lit(len(prefix) + 1)))).otherwise(clean)
