"""Facts from repository artifacts (repo, path, content): owners, schemas, manifests, contracts, infrastructure, code signals, events.

Artifacts become a table of lines; what a line says is matched with built-in expressions, and what an earlier line
left open (the current table, the last untrusted input) is carried forward by a window within the file.
Facts are (src, rel, dst, kind, path, line); all are static evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.structure import is_test

#: Signals of a code line: name, kind of the entity, relation, whether the entity is the source, and what the line contains in lower case.
SIGNALS = [
    ("input", "parameter", "trust_boundary", True, ["req.body", "request.body", "req.query", "request.query", "req.params", "request.params", "request.form", "stdin", "argv", "location.search", "urlsearchparams"]),
    ("sanitizer", "symbol", "sanitizes", False, ["sanitize(", "escape(", "validator.", "validate(", "parse.safe", "safeparse(", "zod", "joi.", "htmlspecialchars", "parameterize", "preparedstatement"]),
    ("sink", "runtime_resource", "writes", False, ["exec(", "spawn(", "system(", "eval(", "innerhtml", "dangerouslysetinnerhtml", "query(", "execute(", "rawquery", "writefile", "createwrite", "fetch(", "axios.", "http.request", "redirect("]),
    ("event", "event", "publishes", False, [".publish(", ".emit(", ".send(", "producer.send", "publish("]),
    ("subscription", "event", "consumes", True, [".subscribe(", ".consume(", "consumer.on", "addlistener("]),
    ("transaction", "transaction", "begins_transaction", False, ["transaction(", "begin transaction", "$transaction", "atomic("]),
    ("lock", "lock", "acquires", False, ["mutex", ".lock(", "rwlock", "semaphore", "synchronized"]),
    ("api", "api", "defines", False, ["app.get(", "app.post(", "app.put(", "app.delete(", "router.get(", "router.post(", "@getmapping", "@postmapping", "@app.get", "@app.post", "http.handlefunc"]),
    ("test", "test", "exercises", True, ["assert", "expect(", "should(", "pytest", "test(", "it("]),
    ("retry", "runtime_resource", "retries", False, ["retry", "backoff"]),
    ("timeout", "runtime_resource", "times_out", False, ["timeout"]),
    ("circuit", "runtime_resource", "circuit_breaks", False, ["circuitbreaker", "circuit_breaker", "circuit breaker"]),
]
#: Calls that name an event, topic or queue, their relation, and whether the file consumes it.
EVENT_CALLS = [
    ("emit", "event", "emits", False), ("publish", "topic", "publishes", False), ("produce", "topic", "publishes", False), ("send", "queue", "publishes", False),
    ("subscribe", "topic", "subscribes", True), ("consume", "queue", "consumes", True), ("on", "event", "consumes", True),
]


def lines(artifacts: DataFrame) -> DataFrame:
    """(repo, path, line, text)"""
    clean = F.regexp_replace("content", "\r\n?", "\n")
    return artifacts.where("content IS NOT NULL AND path IS NOT NULL").select("repo", "path", F.posexplode(F.split(clean, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def file_id() -> Column:
    return F.concat(F.lit("repo:"), F.coalesce("repo", F.lit("")), F.lit("::file:"), F.col("path"))


def _facts(df: DataFrame, src: Column, rel: Column | str, dst: Column, kind: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(src.alias("src"), lit(rel).alias("rel"), dst.alias("dst"), lit(kind).alias("kind"), "path", "line").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: The first '=' of a line that assigns: not part of a comparison or an arrow.
_ASSIGNS = r"^([^=]*?[^=!<>])=(?![=>])"


def assigned(text: Column) -> Column:
    """The name that a line assigns to, null if it assigns nothing."""
    left = F.rtrim(F.regexp_replace(F.regexp_extract(F.trim(text), _ASSIGNS, 1), r"[+\-*/%&|^]$", ""))
    return F.nullif(F.regexp_replace(F.element_at(F.split(left, r"\s+"), -1), r"^[^\p{L}\p{N}_$]+|[^\p{L}\p{N}_$]+$", ""), F.lit(""))


def signals(rows: DataFrame) -> DataFrame:
    """What code lines do, each as an entity of its line; what is assigned, and sinks and sanitisers, also take from the last untrusted input before them in the file."""
    low = F.lower("text")
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    relation = lambda name, rel: F.when(any_of(["assert", "expect("]), "asserts").otherwise(rel) if name == "test" else F.lit(rel)
    kinds = [
        F.when(any_of(words) & (is_test(F.lower("path")) if name == "test" else F.lit(True)), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), relation(name, rel).alias("rel"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("value")))
        for name, kind, rel, source, words in SIGNALS
    ]
    value = assigned(F.col("text"))
    hit = F.array_compact(F.array(*kinds, F.when(value.isNotNull(), F.struct(F.lit("value").alias("name"), F.lit("value").alias("kind"), F.lit("assigns").alias("rel"), F.lit(False).alias("source"), value.alias("value")))))
    got = rows.select("repo", "path", "line", F.explode(hit).alias("s")).select("repo", "path", "line", "s.*")
    own = F.concat_ws(":", F.concat(file_id(), F.lit("::"), F.col("name")), F.coalesce("value", F.col("line").cast("string")))
    got = got.withColumn("id", own)
    direct = got.where("name NOT IN ('sanitizer', 'value')")
    plain = _facts(direct, F.when(F.col("source"), F.col("id")).otherwise(file_id()), F.col("rel"), F.when(F.col("source"), file_id()).otherwise(F.col("id")), F.col("kind"))
    # on one line, input comes first, then the assignment, the sanitiser and the sink
    order = F.array_position(F.lit(["input", "value", "sanitizer", "sink"]), F.col("name"))
    w = W.partitionBy("repo", "path").orderBy("line", order).rowsBetween(W.unboundedPreceding, -1)
    flow = got.where("name IN ('input', 'value', 'sanitizer', 'sink')").withColumn("last", F.last(F.when(F.col("name").isin("input", "sanitizer"), F.col("id")), ignorenulls=True).over(w))
    return plain.unionByName(_facts(flow.where("name <> 'input' AND last IS NOT NULL"), F.col("last"), F.col("rel"), F.col("id"), F.col("kind")))


def events(rows: DataFrame) -> DataFrame:
    """Literal names of events, topics and queues in calls: producer to name, name to consumer."""
    parts = []
    for call, kind, rel, consumes in EVENT_CALLS:
        name = F.explode(F.regexp_extract_all("text", F.lit(rf"\.{call}\(\s*[\"'`]([^\"'`]+)[\"'`]"), 1))
        got = rows.where(F.col("text").contains(f".{call}(")).select("repo", "path", "line", name.alias("name"))
        ident = F.concat(F.lit(f"{kind}:"), F.col("name"))
        parts.append(_facts(got, ident if consumes else file_id(), rel, file_id() if consumes else ident, kind))
    return _union(parts)


def environment(rows: DataFrame) -> DataFrame:
    """Names of environment variables that code reads."""
    name = F.explode(F.array_distinct(F.concat(
        F.regexp_extract_all("text", F.lit(r"(?:process|import\.meta)\.env\.([A-Za-z0-9_]+)"), 1), F.regexp_extract_all("text", F.lit(r"(?:getenv|environ\.get|env::var)\(\s*[\"']([A-Z][A-Z0-9_]*)[\"']"), 1),
        F.regexp_extract_all("text", F.lit(r"environ\[[\"']([A-Z][A-Z0-9_]*)[\"']\]"), 1),
    )))
    got = rows.select("repo", "path", "line", name.alias("name"))
    low = F.lower("name")
    kind = F.when(low.contains("feature"), "feature_flag").when(low.rlike("secret|token|password|passwd|api_?key|private_?key|credential"), "secret").otherwise("configuration")
    return _facts(got, file_id(), "reads", F.concat(F.lit("repo:"), "repo", F.lit("::config:"), "name"), kind)


def codeowners(rows: DataFrame) -> DataFrame:
    got = rows.where(F.col("path").rlike("(^|/)CODEOWNERS$") & F.trim("text").rlike(r"^[^#\s]\S*\s+\S")).withColumn("p", F.split(F.trim("text"), r"\s+"))
    scope = F.concat(F.lit("repo:"), "repo", F.lit("::ownership:"), F.col("p")[0])
    owner = got.select("repo", "path", "line", scope.alias("scope"), F.explode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("o"))
    return _facts(got, file_id(), "defines", scope, "package").unionByName(
        _facts(owner, F.concat(F.lit("owner:"), F.regexp_replace("o", "^@+", "")), "owns", F.col("scope"), F.when(F.col("o").contains("/"), "team").otherwise("owner"))
    )


def schemas(rows: DataFrame) -> DataFrame:
    """Tables and columns of SQL and Prisma texts; a column belongs to the table opened last and not yet closed."""
    t = F.trim("text")
    sql = rows.where(F.col("path").rlike(r"\.(sql|prisma)$")).withColumn("t", t)
    name = F.coalesce(F.nullif(F.regexp_extract("t", r"(?i)^(?:create|alter)\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)", 1), F.lit("")), F.nullif(F.regexp_extract("t", r"^model\s+(\w+)", 1), F.lit("")))
    w = W.partitionBy("repo", "path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    closed = F.col("t").rlike(r"^(\}|\)|;)") | F.col("t").rlike(r"^.*\)\s*;$") & ~F.col("t").rlike(r"\w+\(")
    state = F.when(name.isNotNull(), name).when(closed, F.lit(""))
    got = sql.withColumn("name", name).withColumn("table", F.last(state, ignorenulls=True).over(w))
    table = lambda c: F.concat(F.lit("repo:"), F.coalesce("repo", F.lit("")), F.lit("::table:"), c)
    opened = got.where("name IS NOT NULL")
    col = F.regexp_extract("t", r"^[`\"\[]?(\w+)", 1)
    inner = got.where("name IS NULL AND table <> ''").withColumn("column", col).where("column <> '' AND NOT lower(column) IN ('primary', 'foreign', 'constraint', 'unique', 'key', 'index', 'check')")
    return _facts(opened, file_id(), F.when(F.lower("t").startswith("alter"), "migrates").otherwise("defines"), table(F.col("name")), "table").unionByName(
        _facts(inner, table(F.col("table")), "defines", F.concat(table(F.col("table")), F.lit("."), "column"), "column")
    )


def manifests(artifacts: DataFrame) -> DataFrame:
    """(repo, path, declared, requires): names that package.json, Cargo.toml, go.mod and pyproject.toml declare, and what each needs."""
    file = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    keys = lambda p: F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", p), "map<string,string>")), F.array().cast("array<string>"))
    section = lambda s: F.regexp_extract("content", r"(?ms)^\[" + s + r"\]\s*$(.*?)(?=^\[|\z)", 1)
    toml = lambda s: F.regexp_extract_all(section(s), F.lit(r"(?m)^([\w.-]+)\s*="), 1)
    needs = (
        F.when(file == "package.json", F.concat(keys("$.dependencies"), keys("$.devDependencies"), keys("$.peerDependencies")))
        .when(file == "Cargo.toml", F.concat(toml("dependencies"), toml("dev-dependencies")))
        .when(file == "go.mod", F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v"), 1))
        .when(file == "pyproject.toml", F.concat(F.regexp_extract_all(F.regexp_extract("content", r"(?ms)^dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([\w.-]+)"), 1), toml(r"tool\.poetry\.dependencies")))
    )
    from stratalens.sources.files import package_identity

    own = package_identity(artifacts.where("content IS NOT NULL"))
    return artifacts.where(needs.isNotNull() & F.col("content").isNotNull()).select("repo", "path", F.explode(F.array_distinct(needs)).alias("requires")).join(own.withColumnRenamed("name", "declared"), "repo", "left").select("repo", "path", "declared", "requires")


def resolve_manifests(needs: DataFrame, identities: DataFrame) -> DataFrame:
    """Needs that another repository declares by exactly that name."""
    other = identities.select(F.col("repo").alias("provider"), F.col("name").alias("requires"))
    return needs.join(other, "requires").where("provider <> repo").select("repo", "requires", "provider").distinct()


def contract_fields(rows: DataFrame) -> DataFrame:
    """(repo, path, owner, field, type, required) of GraphQL types (! is required) and Prisma models (? and [] are not)."""
    w = W.partitionBy("repo", "path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = rows.where(F.col("path").rlike(r"\.(graphql|gql|prisma)$")).withColumn("t", F.trim("text"))
    name = F.nullif(F.regexp_extract("t", r"^(?:type|input|interface|model)\s+(\w+)", 1), F.lit(""))
    got = got.withColumn("name", name).withColumn("owner", F.last(F.when(name.isNotNull(), name).when(F.col("t").startswith("}"), F.lit("")), ignorenulls=True).over(w)).where("name IS NULL AND owner <> ''")
    gql = ~F.col("path").endswith(".prisma")
    field = F.when(gql, F.regexp_extract("t", r"^(\w+)\s*(?:\([^)]*\))?\s*:", 1)).otherwise(F.regexp_extract("t", r"^(\w+)\s+\w", 1))
    kind = F.when(gql, F.regexp_extract("t", r":\s*([\[\]\w!]+)\s*(?:@.*|#.*|=.*)?$", 1)).otherwise(F.regexp_extract("t", r"^\w+\s+(\w+(?:\[\]|\?)?)", 1))
    need = F.when(gql, F.col("type").endswith("!")).otherwise(~F.col("type").rlike(r"(\?|\[\])$"))
    return got.withColumn("field", field).withColumn("type", kind).where("field <> '' AND type <> ''").select("repo", "path", "owner", "field", F.regexp_replace("type", r"[!?]", "").alias("type"), need.alias("required"))


def terraform_refs(rows: DataFrame) -> DataFrame:
    """What each resource or module block refers to, but for variables, locals, each and count."""
    w = W.partitionBy("repo", "path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = rows.where(F.col("path").endswith(".tf")).withColumn("t", F.trim("text"))
    name = F.coalesce(
        F.when(F.col("t").rlike(r'^resource\s+"'), F.concat_ws(".", F.regexp_extract("t", r'"([^"]+)"\s+"([^"]+)"', 1), F.regexp_extract("t", r'"([^"]+)"\s+"([^"]+)"', 2))),
        F.when(F.col("t").rlike(r'^module\s+"'), F.concat(F.lit("module."), F.regexp_extract("t", r'"([^"]+)"', 1))),
    )
    got = got.withColumn("name", name).withColumn("block", F.last(name, ignorenulls=True).over(w)).where("block IS NOT NULL AND name IS NULL")
    unquoted = F.regexp_replace("t", r'"(?:[^"$]|\$(?!\{))*"', "")
    ref = F.explode(F.array_distinct(F.regexp_extract_all(unquoted, F.lit(r"\b((?:module\.|data\.)?[a-z][\w]*\.[a-zA-Z_][\w-]*)"), 1)))
    out = got.select("repo", "path", "line", "block", ref.alias("ref")).where("NOT ref RLIKE '^(var|local|each|count|path|self|terraform)\\\\.' AND ref <> block")
    return _facts(out, F.concat(F.lit("infra:"), "block"), "depends_on", F.concat(F.lit("infra:"), "ref"), "runtime_resource")


def extract(artifacts: DataFrame) -> DataFrame:
    """All facts, in a fixed order of extractors, exact repetitions once."""
    rows = lines(artifacts)
    return _union([f(rows) for f in (codeowners, schemas, signals, events, environment, terraform_refs)]).distinct()
