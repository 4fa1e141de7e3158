"""From parsed files to edges: imports, calls, type relations; all by equi-joins on constructed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import paths


def suffixes(files: DataFrame) -> DataFrame:
    """(repo, suffix, path): every tail of a file's path that starts at a part; as many as the path is deep."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select("repo", "path", F.explode(tails).alias("suffix"))


def imports(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo, path, source, target): the file an import means, else null.

    Candidates go in order: the exact path, else a file that alone has it as a tail; an ambiguous tail passes to the
    next candidate.
    """
    tail = suffixes(files.distinct()).groupBy("repo", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"), F.max(F.when(F.col("path") == F.col("suffix"), F.col("path"))).alias("exact"))
    tail = tail.withColumn("target", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))).where("target IS NOT NULL").select("repo", "suffix", "target")
    asked = rows.select("repo", "path", "source").distinct()
    tried = asked.select("*", F.posexplode(paths.candidates(F.col("path"), F.col("source"))).alias("o", "suffix"))
    hit = tried.join(tail, ["repo", "suffix"]).groupBy("repo", "path", "source").agg(F.min_by("target", "o").alias("target"))
    return asked.join(hit, ["repo", "path", "source"], "left")


def calls(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo, path, caller, callee, src, dst): callers must exist; a callee of the same file wins, else the only function of that name."""
    have = nodes.select("repo", "id")
    named = nodes.where(F.lower("kind").isin("function", "method")).select("repo", "id", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("id", "::"), -1)))).alias("callee"))
    only = named.groupBy("repo", "callee").agg(F.countDistinct("id").alias("n"), F.min("id").alias("far")).where("n = 1").drop("n")
    keyed = rows.select("repo", "path", "caller", "callee").distinct().withColumn("src", F.concat_ws("::", "path", "caller")).withColumn("near", F.concat_ws("::", "path", "callee"))
    known = keyed.join(have.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi")
    local = have.select("repo", F.col("id").alias("near"), F.lit(True).alias("local"))
    got = known.join(local, ["repo", "near"], "left").join(only, ["repo", "callee"], "left")
    return got.select("repo", "path", "caller", "callee", "src", F.when(F.col("local"), F.col("near")).otherwise(F.col("far")).alias("dst")).where("dst IS NOT NULL")


def type_relations(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo, src, dst, kind) of extends and implements within one file, where both types exist."""
    have = nodes.select("repo", "id")
    keyed = rows.select("repo", F.concat_ws("::", "path", "source_type").alias("src"), F.concat_ws("::", "path", "target_type").alias("dst"), "kind").distinct()
    return keyed.join(have.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(have.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")


def external_dependencies(rows: DataFrame) -> DataFrame:
    return rows.select("repo", paths.external_root(F.col("source")).alias("package")).where("package IS NOT NULL").distinct()


def identity_path(path: Column) -> Column:
    """A file's path as its identity: normalised, a leading slash kept."""
    return F.concat(F.when(paths.slashed(path).startswith("/"), "/").otherwise(""), paths.normalise(path))


def completed_scan(analyses: DataFrame) -> DataFrame:
    """The state that a whole scan (path, ...) leaves, paths as identities; refused if a path is empty or there twice."""
    state = analyses.withColumn("path", identity_path(F.col("path")))
    if not state.where("path IS NULL OR path = ''").isEmpty():
        raise ValueError("the scan has an empty path")
    if not state.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("the scan has a path twice")
    return state


def require_snapshot(anchored: str | None, expected: str) -> None:
    """Parsed evidence may be changed in place only if it describes the snapshot that is current."""
    if anchored != expected:
        raise ValueError(f"a whole scan is required: the evidence describes {anchored or 'no snapshot'}, current is {expected}")


def apply_delta(state: DataFrame, delta: DataFrame) -> DataFrame:
    """State (path, ...) after a batch of file changes (path, kind add|modify|delete, same other columns).

    The whole batch is refused if any change is impossible: an empty or repeated path, adding what exists, changing or
    deleting what doesn't.
    """
    check = delta.join(state.select("path", F.lit(True).alias("exists")), "path", "left")
    bad = (
        F.coalesce(F.trim("path"), F.lit("")).eqNullSafe("") | (F.lower("kind") == "add") & F.col("exists").isNotNull() | F.lower("kind").isin("modify", "delete") & F.col("exists").isNull()
        | ~F.lower("kind").isin("add", "modify", "delete")
    )
    wrong, twice = check.where(bad).limit(1).count(), delta.groupBy("path").count().where("count > 1").limit(1).count()
    if wrong or twice:
        raise ValueError("the batch of changes contradicts the state; nothing was applied")
    kept = state.join(delta.select("path"), "path", "left_anti")
    return kept.unionByName(delta.where("lower(kind) <> 'delete'").select(*state.columns))


def freshness(was: tuple[str | None, str | None], now: tuple[str | None, str | None]) -> str:
    """From (commit, work-tree fingerprint) then and now: what became of the state."""
    if was[0] is None or now[0] is None:
        return "unknown"
    if was[0] != now[0]:
        return "commit-changed"
    if was[1] is None or now[1] is None:
        return "head-only"
    return "fresh" if was[1] == now[1] else "worktree-changed"


def freshness_of(commit_was: Column, tree_was: Column, commit: Column, tree: Column) -> Column:
    """`freshness` of columns."""
    return (
        F.when(commit_was.isNull() | commit.isNull(), "unknown").when(commit_was != commit, "commit-changed").when(tree_was.isNull() | tree.isNull(), "head-only")
        .when(tree_was == tree, "fresh").otherwise("worktree-changed")
    )


def fingerprint(rows: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """One digest of a set of rows, or of each group of them, whatever their order: sums of two hashes and the count."""
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    part = rows.select(*(by or []), F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(text, F.lit(17)).cast("decimal(38,0)").alias("b"))
    return part.groupBy(*(by or [])).agg(F.md5(F.concat_ws("|", F.sum("a").cast("string"), F.sum("b").cast("string"), F.count(F.lit(1)).cast("string"))).alias("digest"))
