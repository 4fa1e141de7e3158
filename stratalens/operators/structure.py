"""Boundaries, layers, drift rules, test gaps and cloned lines over the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import small
from stratalens.operators.traverse import components, degrees

#: Name suffixes and annotations of layers, in the order in which they are tried.
NAME_SUFFIXES = [
    ("Controller", "presentation"), ("Handler", "presentation"), ("Service", "application"), ("Repository", "data"), ("Entity", "domain"),
    ("Model", "domain"), ("Middleware", "infrastructure"), ("Gateway", "infrastructure"), ("Adapter", "infrastructure"),
]
ANNOTATIONS = [
    ("@Controller", "presentation"), ("@RestController", "presentation"), ("@Service", "application"), ("@Injectable", "application"),
    ("@Repository", "data"), ("@Entity", "domain"), ("@Component", "infrastructure"),
]
#: What a layer may not name.
FORBIDDEN = {
    "domain": ["Controller", "Handler", "Service", "Repository", "Middleware", "Gateway", "Adapter"],
    "application": ["Controller", "Handler", "Middleware"],
    "presentation": ["Repository"],
    "data": ["Controller", "Handler"],
    "infrastructure": ["Controller"],
}
#: Path parts, name suffixes and annotations of the layered pattern.
LAYERS = [
    ("presentation", ["/controllers/", "/presenters/", "/views/"], ["Controller", "Presenter", "View"], ["@Controller", "@RestController"]),
    ("application", ["/services/", "/usecases/", "/application/"], ["Service", "UseCase", "Interactor"], ["@Service", "@UseCase"]),
    ("domain", ["/domain/", "/models/", "/entities/"], ["Entity", "ValueObject", "Aggregate"], ["@Entity", "@DomainService"]),
    ("infrastructure", ["/infrastructure/", "/repositories/", "/gateways/"], ["Repository", "Gateway", "Adapter"], ["@Repository", "@Component"]),
    ("data", ["/data/", "/repositories/impl/", "/dao/"], ["RepositoryImpl", "Dao", "DataSource"], ["@Repository", "@Dao"]),
]
#: Severity of each kind of violation, and the order of severities.
SEVERITY = {
    "forbidden_dependency": "error", "circular_dependency": "critical", "layer_skip": "warning", "boundary_crossing": "error", "god_object": "warning", "unstable_dependency": "info",
}
RANK = {"info": 0, "warning": 1, "error": 2, "critical": 3}
#: Edges that make cycles architectural.
STRUCTURAL_KINDS = ["import", "extends", "implements"]


def _cases(pairs: list[tuple[Column, str]]) -> Column:
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def path_boundaries(nodes: DataFrame) -> DataFrame:
    """(repo, boundary, id) by first path part; paths of one part belong to none, boundaries of one node are none."""
    parts = F.split(F.translate("path", "\\", "/"), "/")
    first = F.when(parts[0].isin("", "src", "."), "root").otherwise(parts[0])
    at = nodes.where(F.size(parts) >= 2).select("repo", first.alias("boundary"), "id")
    several = at.groupBy("repo", "boundary").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return at.join(small(several), ["repo", "boundary"], "left_semi")


def naming_boundaries(nodes: DataFrame, suffixes: list[tuple[str, str]] = NAME_SUFFIXES) -> DataFrame:
    layer = _cases([(F.col("name").endswith(s), layer) for s, layer in suffixes])
    return nodes.withColumn("boundary", layer).where("boundary IS NOT NULL").select("repo", "boundary", "id")


def annotation_boundaries(nodes: DataFrame, annotations: str = "annotations") -> DataFrame:
    """From a column of annotation text, which parsers don't fill but external data may."""
    layer = _cases([(F.col(annotations).contains(s), layer) for s, layer in ANNOTATIONS])
    return nodes.withColumn("boundary", layer).where("boundary IS NOT NULL").select("repo", "boundary", "id")


def layered_pattern(nodes: DataFrame, edges: DataFrame, layers: list[tuple] = LAYERS, annotations: str | None = None) -> DataFrame:
    """Layers by paths, names and, where a column holds them, annotations. Per repository: nodes in each layer, coverage and confidence (mean of coverage and compliance; compliance is 1 if there are edges)."""
    slashed = F.concat(F.lit("/"), F.translate("path", "\\", "/"))
    tests = []
    for name, paths, suffixes, notes in layers:
        cond = F.lit(False)
        for a in notes if annotations else []:
            cond = cond | F.coalesce(F.col(annotations).contains(a), F.lit(False))
        for p in paths:
            cond = cond | slashed.contains(p)
        for s in suffixes:
            cond = cond | F.col("name").endswith(s)
        tests.append((cond, name))
    of = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))
    links = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    got = nodes.withColumn("layer", _cases(tests)).where("layer IS NOT NULL").groupBy("repo", "layer").agg(F.count(F.lit(1)).alias("members"))
    out = got.join(of, "repo").join(links, "repo", "left").withColumn("coverage", F.sum("members").over(W.partitionBy("repo")) / F.col("nodes"))
    compliance = F.when(F.coalesce("edges", F.lit(0)) > 0, 1.0).otherwise(0.0)
    return out.select("repo", "layer", "members", F.round((F.col("coverage") + compliance) / 2, 6).alias("confidence"))


def rule_table(spark, rules: dict[str, list[str]]) -> DataFrame:
    """(boundary, token, ord)"""
    rows = [(b, t, i) for b, ts in rules.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "boundary string, token string, ord int")


def guidelines(members: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(repo, boundary, place, line): a heading for each boundary, its members, and the tokens it must not depend on."""
    sized = members.groupBy("repo", "boundary").agg(F.count(F.lit(1)).alias("members"))
    tokens = None
    for b, ts in rules.items():
        tokens = (F.when if tokens is None else tokens.when)(F.col("boundary") == b, ", ".join(ts))
    lines = [F.concat(F.lit("### Boundary: "), "boundary"), F.concat(F.lit("- Members: "), F.col("members").cast("string")), F.concat(F.lit("- Forbidden dependency tokens: "), tokens) if rules else F.lit(None).cast("string")]
    return sized.select("repo", "boundary", F.posexplode(F.array(*lines)).alias("place", "line")).where("line IS NOT NULL").withColumn("place", F.col("place") + 1)


def forbidden(edges: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """Per edge, boundary of its source and token: the target's id contains the token, letter case counting."""
    of = members.withColumnRenamed("id", "src")
    hit = edges.join(of, ["repo", "src"]).join(small(rules), "boundary").where(F.col("dst").contains(F.col("token")))
    return hit.select("repo", "src", "dst", "boundary", "token").distinct()


def crossings(edges: DataFrame, members: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges from inside a boundary to outside it whose target's name or path contains a forbidden token; the first one counts."""
    inside = edges.join(members.withColumnRenamed("id", "src"), ["repo", "src"])
    outside = inside.join(members.withColumnRenamed("id", "dst"), ["repo", "boundary", "dst"], "left_anti")
    text = F.lower(F.concat_ws(" ", "name", "path"))
    hit = outside.join(nodes.select("repo", F.col("id").alias("dst"), text.alias("text")), ["repo", "dst"]).join(small(rules), "boundary").where(F.col("text").contains(F.lower("token")))
    return hit.groupBy("repo", "src", "dst", "boundary").agg(F.min_by("token", "ord").alias("token"))


def custom_rules(nodes: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(repo, id, rule) of nodes whose id contains a rule's token. Rules are part of the plan, so nodes meet them without a join."""
    hits = F.array_compact(F.array(*[F.when(F.col("id").contains(token), F.lit(rule)) for rule, token in rules.items()]))
    return nodes.select("repo", "id", F.explode(hits).alias("rule"))


def layer_skips(edges: DataFrame, members: DataFrame, order: list[str]) -> DataFrame:
    """Edges whose target's layer lies more than one below the source's; a node counts in its first layer."""
    at = F.array_position(F.lit(order), F.col("boundary")) - 1
    first = members.withColumn("layer", at.cast("int")).where("layer >= 0").groupBy("repo", "id").agg(F.min("layer").alias("layer"))
    a, b = first.select("repo", F.col("id").alias("src"), F.col("layer").alias("from_layer")), first.select("repo", F.col("id").alias("dst"), F.col("layer").alias("to_layer"))
    return edges.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).where("to_layer > from_layer + 1").select("repo", "src", "dst", "kind", "from_layer", "to_layer")


def god_objects(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    return degrees(nodes, edges).where((F.col("fan_in") > most) | (F.col("fan_out") > most)).select("repo", "id", "fan_in", "fan_out")


def unstable(nodes: DataFrame, edges: DataFrame, above: float = 0.7, least_in: int = 5) -> DataFrame:
    d = degrees(nodes, edges).where(F.col("fan_in") > least_in)
    return d.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))).where(F.col("instability") > above).select("repo", "id", "fan_in", "fan_out", F.round("instability", 6).alias("instability"))


def cycles(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(repo, id, component) of nodes on cycles."""
    links = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return components(links.select(F.col("repo").alias("key"), "src", "dst")).select(F.col("key").alias("repo"), F.col("node").alias("id"), "component")


def all_violations(nodes: DataFrame, edges: DataFrame, members: DataFrame, rules: DataFrame, order: list[str], god: int = 20, unstable_in: int = 5, unstable_above: float = 0.7) -> DataFrame:
    """(repo, kind, src, dst, boundary, severity, rank): every rule, most severe first when sorted by rank."""
    none = F.lit(None).cast("string")
    parts = [
        forbidden(edges, members, rules).select("repo", F.lit("forbidden_dependency").alias("kind"), "src", "dst", "boundary"),
        cycles(edges, STRUCTURAL_KINDS).groupBy("repo", "component").agg(F.concat_ws(", ", F.array_sort(F.collect_set("id"))).alias("dst"))
        .select("repo", F.lit("circular_dependency").alias("kind"), F.col("component").alias("src"), "dst", none.alias("boundary")),
        layer_skips(edges, members, order).select("repo", F.lit("layer_skip").alias("kind"), "src", "dst", none.alias("boundary")).distinct(),
        god_objects(nodes, edges, god).select("repo", F.lit("god_object").alias("kind"), F.col("id").alias("src"), none.alias("dst"), none.alias("boundary")),
        unstable(nodes, edges, unstable_above, unstable_in).select("repo", F.lit("unstable_dependency").alias("kind"), F.col("id").alias("src"), none.alias("dst"), none.alias("boundary")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    severity = _cases([(F.col("kind") == k, v) for k, v in SEVERITY.items()])
    return out.withColumn("severity", severity).withColumn("rank", _cases([(F.col("severity") == k, F.lit(v)) for k, v in RANK.items()]).cast("int"))


#: Priority of each piece of advice, with what it is about; the highest comes first.
ADVICE = {"circular_dependency": (9.0, "break the cycle behind an interface"), "no_pattern": (8.0, "organise the code in layers"), "god_object": (7.0, "split by responsibility")}


def suggestions(violations: DataFrame, patterns: DataFrame, n: int = 5) -> DataFrame:
    """(kind, n, priority, advice): what to do about violations, and about code in which no pattern was found, most urgent first."""
    known = F.create_map(*[x for k, (p, t) in ADVICE.items() for x in (F.lit(k), F.struct(F.lit(p).alias("priority"), F.lit(t).alias("advice")))])
    count = violations.where(F.col("kind").isin("circular_dependency", "god_object")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    one = violations.sparkSession.range(1).select(F.lit("no_pattern").alias("kind"), F.lit(1).cast("long").alias("n"))
    none = one.join(patterns.limit(1).select(F.lit("no_pattern").alias("kind")), "kind", "left_anti")
    return count.unionByName(none).withColumn("a", known[F.col("kind")]).select("kind", "n", "a.priority", "a.advice").orderBy(F.col("priority").desc()).limit(n)


def search(violations: DataFrame, patterns: DataFrame, word: str) -> DataFrame:
    """(repo, type, what): patterns by the name of a layer, violations by kind, ends or boundary, that contain the word, letter case aside."""
    w = word.lower()
    text = F.lower(F.concat_ws(" ", "kind", "src", "dst", "boundary"))
    found = patterns.where(F.lower("layer").contains(w)).select("repo", F.lit("pattern").alias("type"), F.col("layer").alias("what"))
    return found.unionByName(violations.where(text.contains(w)).select("repo", F.lit("drift").alias("type"), F.concat_ws(" ", "kind", "src", "dst").alias("what")))


def gate(violations: DataFrame, threshold: str = "error") -> DataFrame:
    return violations.agg(F.count(F.when(F.col("rank") >= RANK[threshold], 1)).alias("blocking")).withColumn("passed", F.col("blocking") == 0)


def is_test(path: Column) -> Column:
    """Test files by path part or file name; either separator."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    name = F.element_at(parts, -1)
    stem = F.split(name, "\\.")[0]
    return (
        F.arrays_overlap(parts, F.lit(["test", "tests", "spec", "specs", "__tests__", "__test__"])) | stem.startswith("test_") | stem.startswith("spec_")
        | stem.endswith("_test") | stem.endswith("Test") | stem.endswith("_spec") | name.contains(".test.") | name.contains(".spec.")
    )


def test_gaps(nodes: DataFrame, edges: DataFrame, tests: Column | None = None) -> DataFrame:
    """Production functions no test calls: callers, criticality and risk."""
    test = tests if tests is not None else is_test(F.col("path")) | F.col("name").startswith("test_")
    marked = nodes.where(F.lower("kind").isin("function", "method")).select("repo", "id", "path", test.alias("test"))
    every = nodes.select("repo", F.col("id").alias("src"), test.alias("test_src"))
    calls = edges.join(every, ["repo", "src"]).groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.max("test_src").alias("covered"))
    prod = marked.where("NOT test").join(calls, ["repo", "id"], "left").fillna(0, ["callers"]).fillna(False, ["covered"])
    risk = F.least(F.col("callers") * 0.25 + 0.3, F.lit(0.98))
    critical = (F.col("callers") >= 2) | F.lower("path").contains("core") | F.lower("path").contains("api")
    return prod.select("repo", "id", "path", "callers", "covered", (~F.col("covered") & critical).alias("critical"), F.when(F.col("covered"), 0.0).otherwise(F.round(risk, 6)).alias("risk"))


def test_gap_summary(gaps: DataFrame) -> DataFrame:
    n, covered = F.count(F.lit(1)), F.count(F.when(F.col("covered"), 1))
    return gaps.groupBy("repo").agg(
        n.alias("production"), covered.alias("covered"), F.round(F.when(n == 0, 100.0).otherwise(100.0 * covered / n), 6).alias("pct"),
        F.count(F.when(F.col("risk") > 0.6, 1)).alias("high_priority"),
    )


CLONE_LINES = 8


def clone_windows(files: DataFrame, key: str, text: str, window: int = CLONE_LINES) -> DataFrame:
    """(key, at, body): every window of `window` lines, normalised: quoted tokens are STR, numeric ones NUM, one blank between."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n\\z", "")
    token = lambda t: F.when(t.rlike("^[\"'`]"), "STR").when(t.rlike("^[0-9]+$"), "NUM").otherwise(t)
    line = lambda x: F.concat_ws(" ", F.transform(F.filter(F.split(F.trim(x), "\\s+"), lambda t: t != ""), token))
    lines = F.transform(F.split(clean, "\n"), line)
    rows = files.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), lines.alias("lines")).where(F.size("lines") >= window)
    starts = F.sequence(F.lit(1), F.size("lines") - window + 1)
    return rows.select("key", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("lines", i, window), "\n").alias("body")))).alias("w")).select("key", "w.at", "w.body")


def clone_clusters(windows: DataFrame) -> DataFrame:
    """Clusters of equal windows: a digest, the number of places, duplicated lines, and the first 120 characters."""
    hashed = windows.select("key", "at", F.md5("body").alias("digest"), F.substring("body", 1, 120).alias("snippet"))
    return hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("key").alias("files"), F.min("snippet").alias("snippet")).where("places > 1").withColumn(
        "duplicate_lines", (CLONE_LINES - 1) * (F.col("places") - 1)
    )


def polynomial_hash(text: Column) -> Column:
    """h = (31 h + byte) mod 1 000 000 007 over the UTF-8 bytes."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    steps = F.sequence(F.lit(0), F.greatest(F.length(hexed) / 2 - 1, F.lit(0)).cast("int"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(0).cast("long"), lambda h, i: (h * 31 + byte(i)) % 1_000_000_007))
