"""Results out: relations as Parquet or JSON, Markdown as text, search-index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relations(relations: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each relation in a folder of its own; ``kind`` is parquet or json."""
    for name, rows in relations.items():
        rows.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/{name}")


def write_markdown(markdown: DataFrame, path: str) -> None:
    markdown.select(F.col("markdown").alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def chunk_index(chunks: DataFrame) -> DataFrame:
    """Chunk rows for a search index, without what only the graph needs."""
    wanted = ["chunk_id", "doc_id", "text", "body", "kind", "caption", "headings", "token_count", "pages", "embedding"]
    return chunks.select(*[c for c in wanted if c in chunks.columns])


def node_index(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", "class", "label", F.array_join("aliases", " ").alias("aliases"), F.to_json("attributes").alias("attributes") if "attributes" in nodes.columns else F.lit("{}").alias("attributes"))
