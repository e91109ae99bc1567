"""All registered queries."""
import importlib

from .registry import ORACLES, QUERIES

MODULES = ("scoring", "curation", "splits", "perturb", "calibrate", "events", "ledger", "streaming", "surface")


def _load():
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}_queries")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
