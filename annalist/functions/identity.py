"""Paths, partitions and addresses. An address is lower(trim(root))::path::partition."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PARTITION = "default"


def normalize_path(path: Column) -> Column:
    """Trim, fold backslashes and runs of slashes, lower-case, strip edge slashes. Blank is the root (empty string)."""
    folded = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/+", "/")
    return F.lower(F.regexp_replace(folded, "^/|/$", ""))


def path_is_valid(path: Column) -> Column:
    """No control characters."""
    return ~F.coalesce(path.rlike(r"[\x00-\x1F\x7F]"), F.lit(True))


def normalize_partition(partition: Column) -> Column:
    """Trimmed and case-sensitive; blank or null is the default partition."""
    p = F.trim(partition)
    return F.when(p.isNull() | (p == ""), DEFAULT_PARTITION).otherwise(p)


def canonical_address(root: Column, path: Column, partition: Column) -> Column:
    return F.concat_ws("::", F.lower(F.trim(root)), normalize_path(path), normalize_partition(partition))


def is_descendant(parent: Column, path: Column) -> Column:
    """Strictly below: the root scope matches every path but itself."""
    return F.when(parent == "", path != "").otherwise(path.startswith(F.concat(parent, F.lit("/"))))


def address_digest(address: Column) -> Column:
    return F.sha2(address, 256)


def history_file(address: Column, revision: Column) -> Column:
    """Place of a record in the directory layout: two-character fan-out, digest, zero-padded revision."""
    d = address_digest(address)
    return F.concat_ws("/", F.substring(d, 1, 2), d, F.lit("history"), F.concat(F.lpad(revision.cast("string"), 20, "0"), F.lit(".json")))


def source_status_key(name: Column) -> Column:
    """A source's name as a metadata key: lower case, all but letters, digits, dot, underscore and minus folded."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}._-]", "_")


def stable_type_name(t) -> str:
    """A readable name of a declared value type that does not depend on the interpreter's run."""
    if isinstance(t, str):
        return re.sub(r"\s+", "", t)
    args = getattr(t, "__args__", None)
    name = getattr(t, "__qualname__", str(t))
    return f"{name}[{','.join(map(stable_type_name, args))}]" if args else name
