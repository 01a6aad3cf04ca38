"""Target labels: ``cell//package/path:name-1.2#config``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import LABEL_CELL, VERSION_SUFFIX


def strip_config(label: Column) -> Column:
    """The label up to its first ``#``."""
    return F.substring_index(label, "#", 1)


def package_of(label: Column) -> Column:
    """Everything before the name: ``cell//a/b`` of ``cell//a/b:c``."""
    return F.substring_index(strip_config(label), ":", 1)


def name_of(label: Column) -> Column:
    return F.substring_index(strip_config(label), ":", -1)


def stem(label: Column, exact_names: Sequence[str] = ()) -> Column:
    """Drop one trailing ``-<digits and dots>``.

    Works on names and on whole labels. Names such as ``md-5`` are cut too, as the
    audited collections expect; ``exact_names`` protects the names it lists.
    """
    cut = F.regexp_replace(label, VERSION_SUFFIX, "")
    if not exact_names:
        return cut
    return F.when(name_of(label).isin(*exact_names), label).otherwise(cut)


def version_of(label: Column) -> Column:
    """The text ``stem`` drops, without its dash; null when it drops nothing."""
    version = F.regexp_extract(label, r"-([0-9][0-9.]*)$", 1)
    return F.when(version != "", version)


def match_names(name: Column) -> Column:
    """The names a crate may have to match ``name``: itself and its stem.

    A version suffix holds no dash, so "equals the crate, or is the crate plus one
    version suffix" is the same as "the crate is one of these", and a join on it is
    an equi-join instead of a regular-expression join.
    """
    return F.array_distinct(F.array(name, stem(name)))


def scope_regex(pattern: Column, cell: str = LABEL_CELL) -> Column:
    """The label prefix a build pattern covers, as a regular expression.

    ``//P/...`` covers P and below, ``//P:`` just P, ``//P`` as ``//P/...``.
    ``//P:x`` covers that one target.
    """
    label = F.concat(F.lit(f"{cell}//"), F.regexp_replace(pattern, "^//", ""))
    # Letters of the path stand for themselves.
    plain = lambda text: F.regexp_replace(text, r"([.+*?()\[\]{}|^$\\])", r"\\$1")
    return (
        F.when(pattern.endswith("/..."), F.concat(F.lit("^"), plain(F.regexp_replace(label, r"/\.\.\.$", "")), F.lit("[/:]")))
        .when(pattern.endswith(":"), F.concat(F.lit("^"), plain(label)))
        .when(pattern.contains(":"), F.concat(F.lit("^"), plain(label), F.lit("$")))
        .otherwise(F.concat(F.lit("^"), plain(label), F.lit("[/:]")))
    )


def scope_key(pattern: Column, cell: str = LABEL_CELL) -> Column:
    """What a build pattern covers as an equi-join key: a kind and a path or label."""
    label = F.concat(F.lit(f"{cell}//"), F.regexp_replace(pattern, "^//", ""))
    kind = (
        F.when(pattern.endswith("/..."), "below ")
        .when(pattern.endswith(":"), "package ")
        .when(pattern.contains(":"), "target ")
        .otherwise("below ")
    )
    return F.concat(kind, F.regexp_replace(label, r"(/\.\.\.|:)$", ""))


def in_scope(label: Column, patterns: Sequence[str], cell: str = LABEL_CELL) -> Column:
    """True when any of a short list of build patterns covers the label.

    Prefix tests instead of one alternation: they are literal, and the Parquet
    reader can skip row groups by them. For pattern tables see
    ``operators.reconcile.scope_to``.
    """

    def covers(pattern: str) -> Column:
        path = f"{cell}//{pattern.removeprefix('//')}"
        if path.endswith("/..."):
            path = path.removesuffix("/...")
        elif path.endswith(":"):
            return label.startswith(path)
        elif ":" in path:
            return label == path
        return label.startswith(f"{path}:") | label.startswith(f"{path}/")

    return reduce(lambda a, b: a | b, [covers(p) for p in patterns], F.lit(False))


def changed_crate(path: Column, shared: str, local: str) -> Column:
    """The crate a changed path belongs to, null when it belongs to none."""
    first = F.regexp_extract(path, shared, 1)
    second = F.regexp_extract(path, local, 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def changed_rig(path: Column, pattern: str) -> Column:
    """The rig whose own directives a changed path belongs to, else null."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
