"""Manifests, locks and directive files: TOML texts to rows.

TOML is read in Arrow batches by the standard library's reader, one text at a
time, inside tasks; everything after that is built-in column expressions.
"""

from __future__ import annotations

import json
import sys
import tomllib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DIRECTIVE_FILE, LOCK_FILE, MAIN_RIG, MANIFEST_FILE, SUB_RIG_MANIFEST
from .files import errors_of, frames, no_errors, read_texts, relative_path

# Tasks get these functions whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPS_SCHEMA = (
    "source STRING, crate STRING, version_req STRING, features ARRAY<STRING>, "
    "default_features BOOLEAN, package STRING"
)
LOCK_SCHEMA = "source STRING, crate STRING, version STRING"
DIRECTIVE_SCHEMA = (
    "source STRING, section_no INT, gate STRING, key STRING, value_kind STRING, value_json STRING"
)


def _rows_of(texts: DataFrame, rows_of_document, schema: str) -> DataFrame:
    """Apply ``rows_of_document(document) -> tuples`` to every TOML text. A text that cannot be read, or is not of the known form, gives one
    row with its ``error`` and no rows besides."""
    names = [field.split()[0] for field in schema.split(", ")] + ["error"]
    blank = (None,) * (len(names) - 2)

    def rows_of(source: str, content: str) -> list[tuple]:
        try:
            return [(source, *row, None) for row in rows_of_document(tomllib.loads(content))]
        except (tomllib.TOMLDecodeError, KeyError, AttributeError, TypeError, RecursionError) as error:
            return [(source, *blank, f"{type(error).__name__}: {error}")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (row for source, content in zip(batch["source"], batch["content"]) for row in rows_of(source, content))
            yield from frames(rows, names)

    return texts.select("source", "content").mapInPandas(parse, f"{schema}, error STRING")


def _dependency_rows(document: dict):
    for crate, value in document.get("dependencies", {}).items():
        if isinstance(value, str):
            yield crate, value, None, None, None
        else:
            yield (
                crate,
                value.get("version"),
                value.get("features"),
                value.get("default-features"),
                value.get("package"),
            )


def _lock_rows(document: dict):
    for package in document.get("package", []):
        yield package["name"], package["version"]


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return "array"
    return "table"


def _section(number: int, gate: str | None, table: dict):
    for key, value in table.items():
        # The build script's own sub-keys are directives in their own right.
        pairs = [(f"{key}.{sub}", v) for sub, v in value.items()] if key == "buildscript" else [(key, value)]
        for name, v in pairs:
            yield number, gate, name, _kind(v), json.dumps(v, ensure_ascii=False)


def _directive_rows(document: dict):
    yield from _section(0, None, {k: v for k, v in document.items() if not k.startswith("cfg(")})
    gates = [k for k in document if k.startswith("cfg(")]
    for number, gate in enumerate(gates, start=1):
        yield from _section(number, gate, document[gate])
    if not document:
        # The file still counts: it overrides a shared file, and can be unused.
        yield 0, None, None, None, None


def parse_manifest_deps(texts: DataFrame) -> DataFrame:
    """``[dependencies]`` of manifests given as ``(source, content)``; those that cannot be read have no rows, see ``file_errors``."""
    return no_errors(_rows_of(texts, _dependency_rows, DEPS_SCHEMA))


def parse_lock_packages(texts: DataFrame) -> DataFrame:
    return no_errors(_rows_of(texts, _lock_rows, LOCK_SCHEMA))


def parse_fixup_directives(texts: DataFrame) -> DataFrame:
    """One row per (source, section, key); the base section is number 0, ungated.

    A file without directives gives one row with a null key.
    """
    return no_errors(_rows_of(texts, _directive_rows, DIRECTIVE_SCHEMA))


KINDS = {
    MANIFEST_FILE: (_dependency_rows, DEPS_SCHEMA),
    LOCK_FILE: (_lock_rows, LOCK_SCHEMA),
    DIRECTIVE_FILE: (_directive_rows, DIRECTIVE_SCHEMA),
}


def text_errors(texts: DataFrame, file_name: str) -> DataFrame:
    """``(source, error)`` of ``(source, content)`` texts that are no manifests, locks or directives, by the name of such files."""
    return errors_of(_rows_of(texts, *KINDS[file_name]))


def file_errors(spark: SparkSession, root: str, file_names: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """``(source, error)`` of all such files below ``root`` that cannot be read; the readers give no rows of them."""
    found = [text_errors(_with_source(read_texts(spark, root, name), root), name) for name in file_names]
    return reduce(DataFrame.unionByName, found)


def _with_source(texts: DataFrame, root: str) -> DataFrame:
    return texts.select(relative_path(F.col("path"), root).alias("source"), "content")


def _rig_of(source, file_name: str):
    return F.regexp_replace(source, F.lit(r"/?\Q" + file_name + r"\E$"), F.lit(""))


def read_manifest_deps(spark: SparkSession, root: str) -> DataFrame:
    """Direct dependencies per rig; the rig is the manifest's folder below ``root``."""
    deps = parse_manifest_deps(_with_source(read_texts(spark, root, MANIFEST_FILE), root))
    return deps.withColumn("source", _rig_of(F.col("source"), MANIFEST_FILE)).withColumnRenamed("source", "rig")


def read_lock_packages(spark: SparkSession, root: str) -> DataFrame:
    """``(rig, crate, version)`` as resolved."""
    packages = parse_lock_packages(_with_source(read_texts(spark, root, LOCK_FILE), root))
    return packages.withColumn("source", _rig_of(F.col("source"), LOCK_FILE)).withColumnRenamed("source", "rig")


def read_fixup_directives(spark: SparkSession, root: str) -> DataFrame:
    """``(rig_scope, crate, section_no, gate, key, value_kind, value_json)``.

    ``rig_scope`` is the rig a directive is local to, empty for shared ones. ``root`` holds folders of
    directives, or is one.
    """
    rows = parse_fixup_directives(_with_source(read_texts(spark, root, DIRECTIVE_FILE), root))
    pattern = r"^(?:(?:(.*)/)?fixups/)?([^/]+)/[^/]+$"
    return rows.select(
        F.regexp_extract("source", pattern, 1).alias("rig_scope"),
        F.regexp_extract("source", pattern, 2).alias("crate"),
        *rows.columns[1:],
    ).where(F.col("crate") != "")


def build_script_view(directives: DataFrame) -> DataFrame:
    """``buildscript.run`` as a flag and an environment map."""
    run = directives.where(F.col("key") == "buildscript.run")
    is_table = F.col("value_kind") == "table"
    return run.withColumn("run", F.when(is_table, F.lit(True)).otherwise(F.col("value_json") == "true")).withColumn(
        "env", F.when(is_table, F.from_json(F.get_json_object("value_json", "$.env"), "MAP<STRING, STRING>"))
    )


def cargo_env_view(directives: DataFrame) -> DataFrame:
    """``cargo_env`` as a flag for all variables or a list of names."""
    env = directives.where(F.col("key") == "cargo_env")
    return env.withColumn("all_names", F.col("value_json") == "true").withColumn(
        "names", F.when(F.col("value_kind") == "array", F.from_json("value_json", "ARRAY<STRING>"))
    )


def extra_dep_view(directives: DataFrame) -> DataFrame:
    """One row per label an ``extra_deps`` directive adds."""
    deps = directives.where(F.col("key") == "extra_deps")
    others = [c for c in deps.columns if c not in ("value_kind", "value_json")]
    return deps.select(*others, F.explode(F.from_json("value_json", "ARRAY<STRING>")).alias("label"))


def rig_inventory(files: DataFrame) -> DataFrame:
    """``(rig, rig_kind, slot)`` from a list of file paths below the root.

    The main rig always counts; another folder counts when it has a manifest.
    """
    spark = files.sparkSession
    found = files.select(F.regexp_extract("path", SUB_RIG_MANIFEST, 1).alias("rig")).where(F.col("rig") != "")
    main = spark.range(1).select(F.lit(MAIN_RIG).alias("rig"))
    rigs = found.distinct().unionByName(main)
    is_slot = F.col("rig").startswith(f"{MAIN_RIG}/snapshots/")
    return rigs.select(
        "rig",
        F.when(F.col("rig") == MAIN_RIG, "main").when(is_slot, "snapshot").otherwise("conflict").alias("rig_kind"),
        F.when(is_slot, F.substring_index("rig", "/", -1)).alias("slot"),
    )
