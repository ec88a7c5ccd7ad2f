"""Shared inputs of the registered queries, built once per plan.

The vocabulary (a pass over every document) feeds several branches of one
plan and the size checks of the ranking kernel, so it is computed once and
checkpointed to the shared checkpoint folder (``materialize``); the plans
that use it start from those files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from semdex.session import materialize
from semdex.sources import testdata as td


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return td.table(self.spark, self.sf_dir, name)

    @cached_property
    def token_counts(self) -> DataFrame:
        return materialize(td.token_counts(self.spark, self.sf_dir))

    @cached_property
    def vocab(self) -> DataFrame:
        return materialize(td.vocabulary_from_counts(self.token_counts))

    @cached_property
    def lexicon(self) -> DataFrame:
        return materialize(td.lang_lexicon(self.spark, self.sf_dir, counts=self.token_counts))

    @cached_property
    def word_vectors(self) -> DataFrame:
        return materialize(td.word_vectors(self.spark, self.sf_dir, self.vocab))

    @cached_property
    def dim(self) -> int:
        return td.vector_dim(td.table_vectors(self.spark, self.sf_dir))

    @cached_property
    def queries(self) -> DataFrame:
        return materialize(td.query_batch(self.spark, self.sf_dir, self.vocab))

    @cached_property
    def tables(self) -> DataFrame:
        return td.table_vectors(self.spark, self.sf_dir)

    # --- catalogue derived from documents -------------------------------------
    @cached_property
    def catalogue_entries(self) -> DataFrame:
        from semdex.sources.catalog import catalogue_from_documents
        return catalogue_from_documents(self.table("documents"))

    @cached_property
    def catalogue_names(self) -> DataFrame:
        """The entries with their columns' names alone, which is what table documents read."""
        from semdex.sources.catalog import catalogue_from_documents
        return catalogue_from_documents(self.table("documents"), names_only=True)

    @cached_property
    def catalogue(self) -> DataFrame:
        from semdex.sources.catalog import catalogue_key
        return materialize(catalogue_key(self.catalogue_entries))

    @cached_property
    def catalogue_heads(self) -> DataFrame:
        """The catalogue without its columns."""
        from semdex.sources.catalog import catalogue_key
        return catalogue_key(self.catalogue_entries.drop("columns"))

    @cached_property
    def catalogue_vectors(self) -> DataFrame:
        """(table_name, document, vec) for every table with a non-empty document."""
        from semdex.plans.index import index_tables
        return materialize(index_tables(self.catalogue_names, self.word_vectors, self.dim)[0])

    @cached_property
    def catalogue_vectors_cut(self) -> DataFrame:
        """``catalogue_vectors`` of the documents' first ``MAX_TOKENS`` tokens, for queries whose SQL states that."""
        from semdex.operators.encode import MAX_TOKENS
        from semdex.plans.index import index_tables
        return materialize(index_tables(self.catalogue_names, self.word_vectors, self.dim, MAX_TOKENS)[0])
