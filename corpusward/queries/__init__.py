"""Registered queries of the rule-check and ledger operators."""

from . import detection, ledger, reports, sources, structure, text  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
