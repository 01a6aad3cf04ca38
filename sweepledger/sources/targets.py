"""Target files: literal rule calls to target and edge tables."""

from __future__ import annotations

import ast
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import LABEL_CELL, TARGET_FILE
from .files import errors_of, frames, no_errors, read_texts, relative_path

# Tasks get these functions whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARSED_SCHEMA = (
    "source STRING, kind STRING, name STRING, crate STRING, edition STRING, version STRING, actual STRING, "
    "features ARRAY<STRING>, deps ARRAY<STRING>, unread ARRAY<STRING>, attrs STRING, error STRING"
)


def _literal(node: ast.expr, names: dict | None = None):
    """The value of a literal, or of one of ``names``; ``dict(a = …)`` counts as one. Nothing is evaluated."""
    if isinstance(node, ast.Name) and node.id in (names or {}):
        return names[node.id]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "dict" and not node.args:
        return {k.arg: _literal(k.value, names) for k in node.keywords}
    if isinstance(node, ast.Dict):
        return {_literal(k, names): _literal(v, names) for k, v in zip(node.keys, node.values)}
    if isinstance(node, ast.List):
        return [_literal(v, names) for v in node.elts]
    return ast.literal_eval(node)


def _calls(text: str) -> Iterator[tuple[ast.Call, dict]]:
    """Rule calls, with the names that stand for literals; a call for each item of a literal list is one per item."""
    names: dict = {}
    for statement in ast.parse(text).body:
        value = getattr(statement, "value", None)
        if isinstance(statement, ast.Assign) and isinstance(statement.targets[0], ast.Name):
            try:
                names[statement.targets[0].id] = _literal(value, names)
            except ValueError:
                continue
        elif isinstance(value, ast.Call):
            yield value, names
        elif isinstance(value, ast.ListComp) and isinstance(value.elt, ast.Call) and len(value.generators) == 1:
            each = value.generators[0]
            if isinstance(each.target, ast.Name) and not each.ifs:
                try:
                    items = _literal(each.iter, names)
                except ValueError:
                    continue
                for item in items:
                    yield value.elt, names | {each.target.id: item}


def _targets_of(text: str) -> Iterator[tuple]:
    for call, names in _calls(text):
        given, unread = {}, []
        for keyword in call.keywords:
            try:
                given[keyword.arg] = _literal(keyword.value, names)
            except ValueError:
                unread.append(keyword.arg)
        if "name" not in given:
            continue
        nested = {k: given.get(k) or {} for k in ("named_deps", "platform", "env")}
        yield (
            ast.unparse(call.func),
            given["name"],
            *(given.get(k) for k in ("crate", "edition", "version", "actual")),
            given.get("features") or [],
            given.get("deps") or [],
            unread,
            json.dumps(nested),
        )


def _parsed(texts: DataFrame) -> DataFrame:
    names = [field.split()[0] for field in _PARSED_SCHEMA.split(", ")]
    blank = (None,) * (len(names) - 2)

    def rows_of(source: str, content: str) -> list[tuple]:
        try:
            return [(source, *row, None) for row in _targets_of(content)]
        except (SyntaxError, ValueError, TypeError, AttributeError, RecursionError, MemoryError) as error:
            return [(source, *blank, f"{type(error).__name__}: {error}")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (row for source, content in zip(batch["source"], batch["content"]) for row in rows_of(source, content))
            yield from frames(rows, names)

    return texts.select("source", "content").mapInPandas(parse, _PARSED_SCHEMA)


def text_errors(texts: DataFrame) -> DataFrame:
    """``(source, error)`` of texts that are no target files."""
    return errors_of(_parsed(texts))


def file_errors(spark: SparkSession, root: str) -> DataFrame:
    """``(source, error)`` of target files below ``root`` that cannot be read; the readers give no rows of them."""
    texts = read_texts(spark, root, TARGET_FILE).select(relative_path(F.col("path"), root).alias("source"), "content")
    return text_errors(texts)


def parse_targets(texts: DataFrame) -> DataFrame:
    """One row per rule call of ``(source, content)`` texts; texts that cannot be read have none, see ``text_errors``.

    ``named_deps``, ``platform_deps`` and ``env`` are maps. ``unread`` names the
    attributes that are no literals; they are left out, since nothing is evaluated.
    """
    names = [field.split()[0] for field in _PARSED_SCHEMA.split(", ") if field != "error STRING"]
    parsed = no_errors(_parsed(texts))
    platforms = F.from_json(
        F.get_json_object("attrs", "$.platform"), "MAP<STRING, STRUCT<deps: ARRAY<STRING>>>"
    )
    return parsed.select(
        *[c for c in names if c != "attrs"],
        F.from_json(F.get_json_object("attrs", "$.named_deps"), "MAP<STRING, STRING>").alias("named_deps"),
        F.transform_values(platforms, lambda _, v: F.coalesce(v["deps"], F.array().cast("array<string>"))).alias(
            "platform_deps"
        ),
        F.from_json(F.get_json_object("attrs", "$.env"), "MAP<STRING, STRING>").alias("env"),
    )


def read_target_graph(spark: SparkSession, root: str, cell: str = LABEL_CELL) -> DataFrame:
    """Targets of every target file below ``root``, with ``rig`` and full ``label``."""
    texts = read_texts(spark, root, TARGET_FILE).select(relative_path(F.col("path"), root).alias("source"), "content")
    rig = F.regexp_replace("source", rf"/?{TARGET_FILE}$", "")
    targets = parse_targets(texts)
    return targets.select(
        rig.alias("rig"), F.concat(F.lit(f"{cell}//"), rig, F.lit(":"), "name").alias("label"), *targets.columns[1:]
    )


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``(label, kind)`` of a stored target table; only these columns are read."""
    return spark.read.schema("label STRING, kind STRING").parquet(path)


def target_edges(targets: DataFrame) -> DataFrame:
    """``(src, dst, platform)``: ``src`` depends on ``dst``; platform is null when always.

    Needs ``label``; dependencies written as ``:name`` are in the same package.
    """
    package = F.substring_index("label", ":", 1)
    always = F.array_compact(F.flatten(F.array("deps", F.map_values("named_deps"), F.array("actual"))))
    gated = F.flatten(
        F.transform(
            F.map_entries("platform_deps"),
            lambda e: F.transform(e["value"], lambda d: F.struct(e["key"].alias("platform"), d.alias("dep"))),
        )
    )
    plain = F.transform(always, lambda d: F.struct(F.lit(None).cast("string").alias("platform"), d.alias("dep")))
    edges = targets.select("label", package.alias("package"), F.inline(F.concat(plain, gated)))
    dep = F.col("dep")
    return edges.select(
        F.col("label").alias("src"),
        F.when(dep.startswith(":"), F.concat("package", dep)).otherwise(dep).alias("dst"),
        "platform",
    )
