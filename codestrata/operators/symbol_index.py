"""Symbols of the files that a change touches, at its head: what a review looks lines and names up in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import paths as P
from codestrata.functions import spans as S
from codestrata.operators import retrieval as R
from codestrata.operators.declarations import declarations
from codestrata.operators.search_many import search_many

#: Kinds of records by kinds of declarations; what has none is no symbol.
KINDS = {"class": "Class", "mixin": "Mixin", "enum": "Enum", "extension": "Extension", "function": "Function", "method": "Method", "getter": "Method", "setter": "Method", "operator": "Method", "constructor": "Method", "variable": "Variable", "field": "Field", "enumerator": "Field"}


def declaration_and_body(span: Column) -> Column:
    """struct(decl_span, body_span): both with all bytes; the declaration has the first line, the body all lines."""
    first = S.span(span["start_line"], span["start_line"], span["start_byte"], span["end_byte"])
    return F.struct(first.alias("decl_span"), span.alias("body_span"))


def decoded(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Files with ``text``; those without content or not in UTF-8 go."""
    text = F.col(content_col).cast("string")
    return files.filter(F.col(content_col).isNotNull() & F.is_valid_utf8(text)).withColumn("text", text).drop(content_col)


def symbol_records(files: DataFrame) -> DataFrame:
    """symbol_id, path, language, kind, name, decl_span, body_span of the symbols of files (path, text); other languages have none."""
    known = files.withColumn("language", P.detect_language(F.col("path"))).filter("language = 'dart'").select("path", "text")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    d = declarations(known).withColumn("kind", kind).filter(S.is_symbolic_kind(F.col("kind"))).withColumn("s", declaration_and_body(F.col("span")))
    key = ids.symbol_id(F.lit("dart"), F.col("path"), F.col("span.start_byte"), F.col("span.end_byte"), F.col("name"), F.col("kind"))
    return d.select(key.alias("symbol_id"), "path", F.lit("dart").alias("language"), "kind", "name", "s.decl_span", "s.body_span")


class RagSearch(Protocol):
    """What a review asks an index for: query_id or pattern, source, snippet, score; by default nothing."""

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """Rows near each query (query_id, vector), at most ``limit`` for each."""

    def by_path_like(self, pattern: str, limit: int) -> DataFrame:
        """Rows whose source holds the pattern."""

    def by_symbol_like(self, pattern: str, limit: int) -> DataFrame:
        """Rows whose qualified name holds the pattern."""


class NoSearch:
    """An index that holds nothing."""

    def __init__(self, spark):
        self.spark = spark

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        return self.spark.createDataFrame([], "query_id string, source string, snippet string, score double")

    def by_path_like(self, pattern: str, limit: int) -> DataFrame:
        return self.spark.createDataFrame([], "source string, snippet string, score double")

    by_symbol_like = by_path_like


class TableSearch:
    """An index over rows (id, source, fqn, snippet, embedding)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        hits = search_many(self.rows, queries.select("query_id", F.col("vector").alias("embedding")), limit)
        own = self.rows.select(F.col("id").cast("string").alias("id"), "source", "snippet")
        return hits.join(own, "id").select("query_id", "source", "snippet", "score")

    def _like(self, column: str, pattern: str, limit: int) -> DataFrame:
        where = F.contains(F.lower(F.col(column)), F.lit(pattern.lower()))
        return R.scroll(self.rows, where, limit).select("source", "snippet", "score")

    def by_path_like(self, pattern: str, limit: int) -> DataFrame:
        return self._like("source", pattern, limit)

    def by_symbol_like(self, pattern: str, limit: int) -> DataFrame:
        return self._like("fqn", pattern, limit)
