"""Table functions for SQL: one text in, its chunks out, to be joined with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillon.operators.markdown import CHUNKS, chunk_text
from quillon.runtime import ship_package


class _Chunks:
    """Chunks of one document, as :func:`quillon.operators.markdown.chunk_documents` gives them."""

    def eval(self, doc_id: str, text: str, most: int = 0, overlap: int = 0) -> Iterator[tuple]:
        for c in chunk_text(text or "", doc_id or "", most or 0, overlap or 0):
            yield c.chunk_id, c.doc_id, c.text, c.path, c.kind, c.position, c.tokens, c.first, c.last


def register(spark: SparkSession) -> None:
    """``quillon_chunks(doc_id, text [, most, overlap])`` for this session's SQL: ``FROM docs, LATERAL quillon_chunks(docs.doc_id, docs.text)``. Rows travel in Arrow batches."""
    ship_package(spark)
    spark.udtf.register("quillon_chunks", udtf(_Chunks, returnType=CHUNKS, useArrow=True))
