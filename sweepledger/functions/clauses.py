"""Gates as clauses: any of these, each of which is all of its tests.

The one helper that runs in Python: it reads a gate's text, once per distinct gate.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark import cloudpickle

# Tasks get these functions whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ATTRIBUTES = ("version", "target_os", "target_arch", "target_env")
TOKEN = re.compile(r'\s*(?:(cfg|all|any)\s*\(|(\w+)\s*=\s*"([^"]*)"|([,)]))')


def clauses_of(gate: str) -> list[list[tuple[str, str]]] | None:
    """The tests of each clause, or None if the gate is not understood.

    Known are the tests of ``ATTRIBUTES`` below ``cfg``, ``all`` and ``any``, of any depth.
    """
    open_: list[tuple[str, list]] = [("", [])]
    at, whole = 0, gate.strip()
    while at < len(whole):
        found = TOKEN.match(whole, at)
        if not found:
            return None
        at = found.end()
        group, attribute, value, mark = found.groups()
        if group:
            open_.append((group, []))
        elif attribute:
            if attribute not in ATTRIBUTES:
                return None
            open_[-1][1].append([[(attribute, value)]])
        elif mark == ")":
            if len(open_) < 2:
                return None
            kind, parts = open_.pop()
            if kind == "cfg" and len(parts) != 1:
                return None
            if kind == "any":
                merged = [clause for part in parts for clause in part]
            else:
                merged = [sum(some, []) for some in product(*parts)]
            open_[-1][1].append(merged)
    return open_[0][1][0] if len(open_) == 1 and len(open_[0][1]) == 1 and whole.startswith("cfg") else None


CLAUSES = "gate STRING, clause INT, read BOOLEAN, tests ARRAY<STRUCT<attr: STRING, value: STRING>>"


def read_clauses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``CLAUSES`` for each ``gate``: one per clause, or one that says that it is not understood."""
    for batch in batches:
        rows = []
        for gate in batch["gate"]:
            clauses = clauses_of(gate)
            if clauses is None:
                rows.append((gate, None, False, None))
            for n, tests in enumerate(clauses or []):
                distinct = dict.fromkeys(tests)
                rows.append((gate, n, True, [{"attr": a, "value": v} for a, v in distinct]))
        yield pd.DataFrame(rows, columns=["gate", "clause", "read", "tests"])
