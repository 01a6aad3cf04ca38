"""Versions and the gates that test them and the platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION_ATOM = r'version\s*=\s*"([^"]*)"'


def version_key(version: Column) -> Column:
    """Components as numbers, padded to three, so that plain ``<`` orders versions.

    Pre-release and build parts are left out; see ``is_prerelease``.
    """
    release = F.trim(F.substring_index(F.substring_index(version, "+", 1), "-", 1))
    numbers = F.split(release, r"\.").try_cast("array<bigint>")
    padding = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(3) - F.size(numbers)))
    return F.concat(numbers, padding)


def is_prerelease(version: Column) -> Column:
    return F.substring_index(version, "+", 1).contains("-")


def is_read(gate: Column) -> Column:
    """Whether a gate is understood: null, or all its tests are known and one version test at most has a known form.

    Known are ``version``, ``target_os``, ``target_arch`` and ``target_env``, below ``cfg``, ``all`` and ``any``.
    """
    text = F.regexp_extract(gate, _VERSION_ATOM, 1)
    known_form = text.rlike(r"^\s*(>=\s*[0-9][0-9.]*\s*(,\s*<\s*[0-9][0-9.]*\s*)?|<\s*[0-9][0-9.]*\s*|=\s*[0-9][0-9.]*\s*)$")
    n_tests = F.regexp_count(gate, F.lit(_VERSION_ATOM))
    rest = F.regexp_replace(gate, r'(version|target_os|target_arch|target_env)\s*=\s*"[^"]*"', "")
    plain = F.regexp_replace(rest, r"\b(cfg|all|any)\s*\(", "").rlike(r"^[\s,)]*$")
    return gate.isNull() | (plain & ((n_tests == 0) | ((n_tests == 1) & known_form)))


def parse_version_gate(gate: Column) -> Column:
    """Bounds of a gate's version test, if it has one of the usual forms. Gates of any form are read as clauses, see ``operators.gates``.

    ``>=a``, ``<b``, both, or ``=a``; an open side is null. ``exact`` marks ``=a``,
    ``version_only`` a gate that tests nothing else. Null when no version is tested.
    A gate that is not understood (see ``is_read``) gets bounds that no version is in.
    """
    nothing = F.array(F.lit(2**63 - 1))
    text = F.regexp_extract(gate, _VERSION_ATOM, 1)
    low = F.nullif(F.regexp_extract(text, r">=\s*([0-9][0-9.]*)", 1), F.lit(""))
    high = F.nullif(F.regexp_extract(text, r"<\s*([0-9][0-9.]*)", 1), F.lit(""))
    exact = F.nullif(F.regexp_extract(text, r"^\s*=\s*([0-9][0-9.]*)", 1), F.lit(""))
    return F.when(
        text != "",
        F.struct(
            F.when(is_read(gate), version_key(F.coalesce(exact, low))).otherwise(nothing).alias("lo"),
            F.when(is_read(gate), version_key(F.coalesce(exact, high))).otherwise(nothing).alias("hi"),
            exact.isNotNull().alias("hi_inc"),
            exact.isNotNull().alias("exact"),
            gate.rlike(r'^cfg\(\s*version\s*=\s*"[^"]*"\s*\)$').alias("version_only"),
        ),
    )


_REQUIREMENT = r"^\s*(\^|~|=|>=|>|<=|<)?\s*([0-9]+(?:\.[0-9]+){0,2})((?:\.[*xX]){0,2})(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?\s*$"


def _bumped(numbers: Column, at: Column) -> Column:
    """The first version after all that begin with ``numbers`` up to place ``at``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda i: F.when(i < at, F.get(numbers, i)).when(i == at, F.get(numbers, i) + 1).otherwise(F.lit(0).cast("bigint")),
    )


def _one_range(piece: Column) -> Column:
    """``struct<lo, hi, read>`` of one comparison of a requirement."""
    part = lambda n: F.regexp_extract(piece, _REQUIREMENT, n)
    operator, wild, pre = part(1), part(3) != "", part(4) != ""
    given = F.split(part(2), r"\.").try_cast("array<bigint>")
    numbers = version_key(part(2))
    last = F.size(given) - 1
    first = F.coalesce(F.nullif(F.array_position(F.transform(given, lambda n: n > 0), F.lit(True)), F.lit(0)) - 1, last)
    nothing = F.lit(None).cast("array<bigint>")
    caret = (operator == "^") | (operator == "") & ~wild
    at = F.when(caret, first).when(operator == "~", F.least(last, F.lit(1))).otherwise(last)
    after = _bumped(numbers, at)
    # Pre-releases are never offered, so a bound at one stands at its release; nothing equals one.
    lo = F.when(operator == ">", F.when(pre, numbers).otherwise(after)).when(operator.isin("<", "<="), nothing).otherwise(numbers)
    hi = (
        F.when(operator == "<", numbers)
        .when(operator == "<=", F.when(pre, numbers).otherwise(after))
        .when(operator.isin(">", ">="), nothing)
        .when((operator == "=") & pre, numbers)
        .otherwise(after)
    )
    whole = F.trim(piece).isin("*", "")
    return F.struct(
        F.when(~whole, lo).alias("lo"),
        F.when(~whole, hi).alias("hi"),
        (whole | F.coalesce(piece.rlike(_REQUIREMENT), F.lit(False))).alias("read"),
    )


def requirement_range(requirement: Column) -> Column:
    """``struct<lo, hi, read>``: a version requirement as a half-open interval of padded versions, null where it is open.

    Comparisons apart by commas must all hold. Bare versions and ``^`` allow what does not change the first part that is not zero, ``~`` what
    changes the last of three parts only, ``=`` and ``1.2.*`` what begins with the parts given; ``>``, ``>=``, ``<`` and ``<=`` are
    bounds, of fewer parts for all versions that begin with them; ``*`` and an empty text allow all. Build parts do not count; pre-releases
    are no candidates, so a bound at one stands at its release. ``read`` is false for other texts; they
    allow nothing. An interval may be empty. A null requirement gives null.
    """
    pieces = F.transform(F.split(requirement, ","), _one_range)
    bounds = lambda side: F.filter(F.transform(pieces, lambda p: p[side]), lambda b: b.isNotNull())
    read = F.forall(pieces, lambda p: p["read"])
    nothing = F.array(F.lit(2**63 - 1))
    none = F.array(F.lit(-1).cast("bigint"))
    return F.when(
        requirement.isNotNull(),
        F.struct(
            F.when(read, F.array_max(bounds("lo"))).otherwise(nothing).alias("lo"),
            F.when(read, F.array_min(bounds("hi"))).otherwise(none).alias("hi"),
            read.alias("read"),
        ),
    )


def in_range(key: Column, lo: Column, hi: Column) -> Column:
    """``key`` lies in ``[lo, hi)``; null is open."""
    return (lo.isNull() | (key >= lo)) & (hi.isNull() | (key < hi))


def within(key: Column, lo: Column, hi: Column, hi_inc: Column) -> Column:
    """``key`` lies in ``[lo, hi)``, or ``[lo, hi]`` when ``hi_inc``; null is open."""
    return (lo.isNull() | (key >= lo)) & (hi.isNull() | (key < hi) | (hi_inc & (key == hi)))
