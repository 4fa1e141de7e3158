"""Where results go: snapshots of graphs, reports in common formats."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Graphs as Parquet partitions by snapshot, with a table of what there is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, snapshot_id: str, taken_at: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Write a snapshot; one of the same id is replaced. It is listed only once its content is there."""
        for name, df in (("nodes", nodes), ("edges", edges)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/snapshot_id={snapshot_id}")
        size = [self.spark.read.parquet(f"{self.path}/{n}/snapshot_id={snapshot_id}").count() for n in ("nodes", "edges")]
        row = self.spark.createDataFrame([(taken_at, *size)], "taken_at string, node_count long, edge_count long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/snapshot_id={snapshot_id}")

    def list(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/snapshots").parquet(f"{self.path}/snapshots/*").orderBy(F.col("taken_at").desc(), "snapshot_id")

    def latest(self) -> str | None:
        row = self.list().first()
        return row.snapshot_id if row else None

    def load(self, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.parquet(f"{self.path}/{n}/snapshot_id={snapshot_id}") for n in ("nodes", "edges"))

    def delete(self, snapshot_id: str) -> None:
        """Off the list first, then the content."""
        for name in ("snapshots", "nodes", "edges"):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/snapshot_id={snapshot_id}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def content_id(df: DataFrame) -> str:
    """A name for a set of rows by their content."""
    from stratalens.operators.resolve import fingerprint

    return fingerprint(df, df.columns).first().digest


#: Level of each severity in a SARIF report.
LEVELS = {"critical": "error", "error": "error", "warning": "warning", "info": "note"}


def sarif(violations: DataFrame) -> DataFrame:
    """One column `json`: a result for each violation."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    text = F.concat_ws(" -> ", "src", "dst")
    where = F.array(F.struct(F.struct(F.struct(F.split("src", "::")[0].alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return violations.select(F.to_json(F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), where.alias("locations"))).alias("json"))


def sarif_document(results: DataFrame, tool: str = "stratalens") -> str:
    """The report as text; for reports, which people read, not for tables."""
    body = ",".join(r.json for r in results.toLocalIterator())
    return '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s"}},"results":[%s]}]}' % (tool, body)


def junit(violations: DataFrame) -> DataFrame:
    name, text = F.concat_ws(": ", "kind", "src"), F.concat_ws(" -> ", "src", "dst")
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return violations.select(F.concat(F.lit('<testcase name="'), safe(name), F.lit('"><failure message="'), safe(text), F.lit('"/></testcase>')).alias("xml"))


def dot(edges: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(q("src"), F.lit(" -> "), q("dst"), F.lit(' [label="'), "kind", F.lit('"];')).alias("line"))


def mermaid(edges: DataFrame) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), F.substring(F.md5(c), 1, 10), F.lit('["'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"]'))
    return edges.select(F.concat(name("src"), F.lit(" -->|"), "kind", F.lit("| "), name("dst")).alias("line"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.concat(F.lit('<node id="'), safe("id"), F.lit('"/>')).alias("line"))
    return n.unionByName(edges.select(F.concat(F.lit('<edge source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('" label="'), safe("kind"), F.lit('"/>')).alias("line")))


def prompt_context(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Callers and dependencies of one file's nodes, as tagged text."""
    own = nodes.where(F.col("path") == path).select("repo", "id")
    into = edges.join(own.withColumnRenamed("id", "dst"), ["repo", "dst"]).select(F.lit("caller").alias("tag"), F.col("src").alias("id")).distinct()
    out = edges.join(own.withColumnRenamed("id", "src"), ["repo", "src"]).select(F.lit("dependency").alias("tag"), F.col("dst").alias("id")).distinct()
    body = "".join(f"<{r.tag}>{escape(r.id)}</{r.tag}>" for r in into.unionByName(out).orderBy("tag", "id").toLocalIterator())
    return f'<context file="{escape(path)}">{body}</context>'


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A page with the head of each table, which says how many rows it leaves out. For whole tables see `markdown_rows`."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        got = df.limit(rows + 1).collect()
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got[:rows]]
        if len(got) > rows:
            out += ["", f"{df.count() - rows} more rows"]
    return "\n".join(out) + "\n"


def markdown_rows(df: DataFrame) -> DataFrame:
    """Every row as a line of a table."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_lines(lines: DataFrame, path: str, head: list[str] = (), tail: list[str] = ()) -> None:
    """Lines of a report as text files, with what opens and closes it in files that sort before and after them. Nothing passes through the driver."""
    spark = lines.sparkSession
    for place, rows in (("0-head", head), ("2-tail", tail)):
        if rows:
            spark.createDataFrame([(r,) for r in rows], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/{place}")
    lines.select(lines.columns[0]).write.mode("overwrite").text(f"{path}/1-body")


#: What opens and closes a graph in each format.
FRAMES = {
    "dot": (["digraph g {"], ["}"]), "mermaid": (["graph LR"], []), "graphml": (['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'], ["</graph></graphml>"]),
    "junit": (['<?xml version="1.0" encoding="UTF-8"?>', '<testsuites><testsuite name="drift">'], ["</testsuite></testsuites>"]),
}
