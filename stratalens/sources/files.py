"""Source files, archives, manifests and git logs as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.common import ship

#: Endings of files that can be parsed, and directories that a walk leaves out.
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java"}
SKIPPED = [".git", "node_modules", "target", "dist", "build", ".next", "vendor", "coverage", ".turbo", ".yarn"]
#: Limits of an archive in bytes, unpacked bytes and files.
ARCHIVE_BYTES, UNPACKED_BYTES, ARCHIVE_FILES = 60_000_000, 300_000_000, 30_000
ARTIFACT_BYTES, ARTIFACTS = 2_000_000, 25_000


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def ignore_to_regex(pattern: str) -> str:
    """One line of an ignore file as a regular expression over slash-led relative paths."""
    p = pattern.strip()
    anchored = "/" in p.rstrip("/")
    only_dir = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif p[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^/" if anchored else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)")


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(path, language, content) of parsable files under a root, by path; ignore lines or skipped directories leave files out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").format("binaryFile").load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")
    got = raw.select(path.alias("path"), F.col("content").cast("string").alias("content")).withColumn("language", language(F.col("path")))
    for line in ignore or []:
        if line.strip() and not line.startswith("#"):
            got = got.where(~F.concat(F.lit("/"), "path").rlike(ignore_to_regex(line)))
    if skip is not None:
        got = got.where(~F.concat(F.lit("/"), "path").rlike("/(" + "|".join(map(re.escape, skip)) + ")/"))
    return got.select("path", "language", "content")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Files of at most 2 MB, the first 25,000 by path: a limit of the feature."""
    raw = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).where(F.col("length") <= ARTIFACT_BYTES)
    return raw.orderBy("path").limit(ARTIFACTS).select("path", F.col("content").cast("string").alias("content"))


def unzip(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(archive, path, content, refused) of every parsable file in zip archives, given as bytes or as base64 texts.

    What is refused is a row with the reason instead of a content: archives over the limits or unreadable (path null),
    and names that lead out of the archive.
    """

    def rows_of(archive: str, blob: bytes | None) -> Iterator[tuple]:
        if blob is None:
            yield archive, None, None, "no content"
            return
        if len(blob) > ARCHIVE_BYTES:
            yield archive, None, None, "archive too large"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > ARCHIVE_FILES:
                    yield archive, None, None, "too many files"
                    return
                if sum(i.file_size for i in infos) > UNPACKED_BYTES:
                    yield archive, None, None, "unpacked too large"
                    return
                for i in infos:
                    parts = i.filename.replace("\\", "/").split("/")
                    if i.filename.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
                        continue
                    if ".." in parts or parts[0] == "" or ":" in parts[0]:
                        yield archive, i.filename, None, "leads out of the archive"
                    else:
                        yield archive, "/".join(parts), z.read(i).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError):
            yield archive, None, None, "unreadable"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, blob in zip(batch["archive"], batch["blob"]):
                yield pd.DataFrame(list(rows_of(archive, blob)), columns=["archive", "path", "content", "refused"], dtype=object)

    ship(archives.sparkSession)
    blob = F.unbase64(content) if dict(archives.dtypes)[content] == "string" else F.col(content)
    return archives.select(F.col(name).alias("archive"), blob.alias("blob")).mapInPandas(run, "archive string, path string, content string, refused string")


def package_identity(manifests: DataFrame) -> DataFrame:
    """(repo, name) from manifests (repo, path, content): the first of package.json, Cargo.toml, go.mod, pyproject.toml that names one."""
    file = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    section = lambda s: F.regexp_extract("content", r"(?s)\[" + s + r"\][^\[]*?\bname\s*=\s*[\"']([^\"']+)[\"']", 1)
    name = (
        F.when(file == "package.json", F.get_json_object("content", "$.name")).when(file == "Cargo.toml", section("package"))
        .when(file == "go.mod", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1)).when(file == "pyproject.toml", F.coalesce(F.nullif(section("project"), F.lit("")), section(r"tool\.poetry")))
    )
    rank = F.array_position(F.lit(["package.json", "Cargo.toml", "go.mod", "pyproject.toml"]), file)
    return manifests.select("repo", F.nullif(F.trim(name), F.lit("")).alias("name"), rank.alias("rank")).where("name IS NOT NULL").groupBy("repo").agg(F.min_by("name", "rank").alias("name"))


def git_log(texts: DataFrame, column: str = "value") -> DataFrame:
    """(id, author, at, subject, path, adds, dels) from `git log --numstat` texts with headers 'commit|author|epoch|subject' marked by \\x1e. Binary files count no lines."""
    commits = texts.select(F.explode(F.split(column, "\u001e")).alias("c")).where(F.trim("c") != "")
    lines = commits.select(F.split(F.trim("c"), "\r?\n").alias("l"))
    head = F.split(F.col("l")[0], r"\|", 4)
    body = lines.select(head.alias("h"), F.explode_outer(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("f"))
    cols = F.split("f", "\t")
    n = lambda i: F.expr(f"try_cast(get(split(f, '\\t'), {i}) AS bigint)")
    return body.select(
        F.col("h")[0].alias("id"), F.get("h", F.lit(1)).alias("author"), F.expr("try_cast(get(h, 2) AS bigint)").alias("at"), F.get("h", F.lit(3)).alias("subject"),
        F.get(cols, F.lit(2)).alias("path"), F.coalesce(n(0), F.lit(0)).alias("adds"), F.coalesce(n(1), F.lit(0)).alias("dels"),
    ).where("path IS NOT NULL")


def openapi_endpoints(specs: DataFrame) -> DataFrame:
    """(service, method, path, key, request, response) from JSON specifications (service, content)."""
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")
    methods = ["get", "put", "post", "delete", "patch", "head", "options"]
    rows = specs.select("service", F.explode(paths).alias("path", "ops")).select("service", "path", F.explode("ops").alias("method", "op")).where(F.lower("method").isin(methods))
    schema = lambda p: F.get_json_object("op", p)
    return rows.select(
        "service", F.upper("method").alias("method"), "path", F.concat_ws(":", F.upper("method"), "path").alias("key"),
        schema("$.requestBody.content['application/json'].schema").alias("request"), schema("$.responses['200'].content['application/json'].schema").alias("response"),
    )


def schema_fields(endpoints: DataFrame, column: str) -> DataFrame:
    """(service, key, field) of a JSON schema's properties."""
    props = F.map_keys(F.from_json(F.get_json_object(column, "$.properties"), "map<string,string>"))
    return endpoints.select("service", "key", F.explode(props).alias("field"))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON files of one document each."""
    return spark.read.option("multiLine", "true").json(path)
