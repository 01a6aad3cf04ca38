"""All audits; importing a module of audits registers them."""

from . import changes, collections, files, graphs, sweeps, texts, trees, versions  # noqa: F401
from .registry import AUDITS, ORACLES  # noqa: F401
