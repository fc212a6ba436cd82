"""The operators as queries over whole tables: ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import documents
from shelfmark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary_file() -> str:
    """The byte-level vocabulary, at the same place on every machine."""
    place = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(place, "byte_bpe_50k.json")


def on_documents(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(documents(tune(spark), sf_dir))
    if sql is not None:
        ORACLES[name] = sql


def _from(module: str, function: str) -> Callable[..., DataFrame]:
    return lambda *args: getattr(importlib.import_module(f"shelfmark.llm.{module}"), function)(*args)


on_documents("op4_secrets", _from("secrets", "secrets"))
on_documents("op5_quality", _from("quality", "quality"))
on_documents("op7_mixing", _from("mixing", "mix"))
on_documents("op8_bpe", lambda docs: _from("bpe", "digests")(docs, vocabulary_file()))
on_documents("op9_substring", _from("substring", "substring"))
on_documents("op6_suffixes", _from("suffixes", "repeats"))
on_documents("op10_minmax", _from("minmax", "near_duplicates"))
on_documents("op1_weighting", _from("weighting", "scores"))
QUERIES["op3_collisions"] = lambda spark, sf_dir: _from("collisions", "neighbours")(
    tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
on_documents("op2_licenses", _from("licenses", "matches"))
on_documents("op11_fingerprints", _from("fingerprints", "fingerprints"))
on_documents("op12_collocations", _from("collocations", "collocations"))
on_documents("op13_spelling", _from("spelling", "variants"))
