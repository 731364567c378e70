"""The same functions for SQL callers: `register(spark)` defines them as session functions.

Scalars are SQL bodies without Python in the data path; the chunkers, which give rows, are table functions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.operators import text as X

#: SQL bodies; session functions are inlined by the optimizer.
SQL_FUNCTIONS = {
    "cl_basename(path STRING) RETURNS STRING": "element_at(split(path, '/'), -1)",
    "cl_folder_path(relative STRING) RETURNS STRING": "regexp_replace(relative, '/?[^/]*$', '')",
    "cl_excerpt(text STRING) RETURNS STRING": "CASE WHEN length(trim(regexp_replace(text, '\\\\s+', ' '))) > 80 THEN concat(substring(trim(regexp_replace(text, '\\\\s+', ' ')), 1, 77), '...') ELSE trim(regexp_replace(text, '\\\\s+', ' ')) END",
    "cl_idf(total DOUBLE, df DOUBLE) RETURNS DOUBLE": "CASE WHEN df > 0 THEN log1p(total / df) ELSE 0D END",
    "cl_under_root(path STRING, root STRING) RETURNS BOOLEAN": "path = root OR startswith(path, concat(root, '/'))",
}


class FlatPieces:
    """cl_flat_pieces(text, size, overlap): overlapping windows of a text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(X.flat_windows(text or "", size, overlap))


class MarkdownBlocks:
    """cl_markdown_blocks(text): the blocks of a Markdown text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, (kind, block) in enumerate(X.markdown_blocks(text)):
            yield n, kind, block


TABLE_FUNCTIONS = {
    "cl_flat_pieces": udtf(FlatPieces, returnType="piece_no int, piece string"),
    "cl_markdown_blocks": udtf(MarkdownBlocks, returnType="block_no int, kind string, block string"),
}


def register(spark: SparkSession) -> list[str]:
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return [*[s.split("(")[0] for s in SQL_FUNCTIONS], *TABLE_FUNCTIONS]
