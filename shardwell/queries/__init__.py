"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import diff, files, filters, merge, plot, product, profile, transform
from .registry import Registry

MODULES = (profile, diff, merge, filters, plot, files, transform, product)


def all_queries() -> Registry:
    out = Registry()
    for module in MODULES:
        out.update(module.QUERIES)
    return out
