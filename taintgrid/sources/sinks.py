"""Report and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.operators.graph import induced_edges
from taintgrid.operators.report import report_documents, sarif_documents
from taintgrid.session import KEYS

# --- fixed values -------------------------------------------------------------------------
NODE_KINDS = """
PARAMETER ASSIGNMENT RETURN_VALUE FIELD_ACCESS METHOD_CALL OBJECT_CREATION DELEGATE_CALL EXTENSION_CALL CONDITION
LOOP_HEADER EXCEPTION_HANDLER AWAIT_EXPR LAMBDA_CAPTURE LINQ_EXPRESSION STRING_INTERPOLATION STRING_CONCAT
COLLECTION_ITEM KNOWN_SOURCE KNOWN_SINK KNOWN_SANITIZER
""".split()
EDGE_KINDS = """
flows_to aliases assigned_to returned_by captured_by sequential true_branch false_branch exception return calls
called_by overrides taints sanitizes
""".split()
GRAPH_VERSION = "1.0"
# ------------------------------------------------------------------------------------------


def _prefix(df: DataFrame) -> DataFrame:
    return df.withColumn("scan_prefix", F.substring(F.sha2("scan_id", 256), 1, 2))


def write_json_report(vulns: DataFrame, path: str, generated_at: str) -> None:
    """JSON report documents, in folders by a prefix of the scan id's hash so a lookup reads one."""
    docs = report_documents(vulns, generated_at)
    _prefix(docs).select("scan_prefix", "project_id", "scan_id", "page", F.to_json("document").alias("document")).write.mode("overwrite").partitionBy("scan_prefix").json(path)


def load_report(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """The pages of one scan's report. The prefix folder prunes the read."""
    docs = spark.read.schema("project_id string, scan_id string, page int, document string, scan_prefix string").json(path)
    want = F.substring(F.sha2(F.lit(scan_id), 256), 1, 2)
    return docs.where((F.col("scan_prefix") == want) & (F.col("scan_id") == scan_id)).orderBy("page")


def write_sarif(vulns: DataFrame, path: str) -> None:
    """One SARIF log per line, in folders by scan prefix."""
    docs = _prefix(sarif_documents(vulns)).select("scan_prefix", F.to_json("document").alias("value"))
    docs.write.mode("overwrite").partitionBy("scan_prefix").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.withColumn("schema_version", F.lit(GRAPH_VERSION)).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def clean_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes and edges of unknown kind or without their keys, and edges at unknown nodes."""
    kept = nodes.where(F.col("kind").isin(*NODE_KINDS) & F.col("node").isNotNull())
    linked = edges.where(F.col("edge_kind").isin(*EDGE_KINDS) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return kept, induced_edges(linked, kept, KEYS)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The saved graph, cleaned. Another schema version is read all the same."""
    return clean_graph(spark.read.parquet(f"{path}/nodes").drop("schema_version"), spark.read.parquet(f"{path}/edges"))
