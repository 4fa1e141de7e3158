"""Lexical path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings tried for an import, in order, and index files of a directory.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".rs", ".java"]
INDEX_FILES = ["index.ts", "index.tsx", "index.js", "index.py", "mod.rs"]


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalise(path: Column) -> Column:
    """Drops '.' and empty parts, lets '..' take the part before with it."""
    parts = F.filter(F.split(slashed(path), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def directory(path: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("/"), slashed(path)), "/[^/]*$", "")


def candidates(path: Column, source: Column) -> Column:
    """Paths an import may mean, in order, each as written and with every ending and index file.

    Relative ones lie below the importing file's directory, crate ones below its `src`; others, with dots as slashes if
    they have no slash, below the root or else below `src`.
    """
    file = slashed(path)
    crate = source.rlike("^(crate|self|super)::")
    inner = F.regexp_replace(F.regexp_replace(source, "^(crate::)*(self::)*(super::)*", ""), "::", "/")
    home = F.when(file.contains("/src/"), F.concat(F.substring_index(file, "/src/", 1), F.lit("/src"))).otherwise(F.lit("src"))
    plain = F.when(source.contains(".") & ~source.contains("/"), F.regexp_replace(source, r"\.", "/")).otherwise(F.regexp_replace(source, "^/+", ""))
    one = lambda base: F.array(base)
    bases = F.when(source.startswith("."), one(F.concat_ws("/", directory(path), source))).when(crate, one(F.concat_ws("/", home, inner))).otherwise(F.array(plain, F.concat(F.lit("src/"), plain)))
    ends = [*SUFFIXES, *("/" + i for i in INDEX_FILES)]
    return F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(normalise(b), F.lit(e)) for e in ends])))


def external_root(source: Column) -> Column:
    """Package an import comes from: two parts for scoped ones, one otherwise; null for relative imports."""
    root = F.when(source.startswith("@"), F.regexp_extract(source, "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(source, "^([^/.:]+)", 1))
    return F.when(~source.rlike(r"^(\.|/|crate::|self::|super::)"), F.nullif(root, F.lit("")))
