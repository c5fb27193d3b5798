"""Operators for training-data pipelines; nothing else in the package imports this folder.

``queries()`` and ``oracle_sql()`` collect what the operator modules register. All are imported with the package, so that
a library that one of them lacks shows at once, where the entry module leaves the whole folder out.
"""

from __future__ import annotations

from . import compression, context_tree, cover_tree, decontaminate, fill_middle, language_mix, line_chunks, packing, quality, simhash, spelling, toxicity, url_model

MODULES = (language_mix, quality, context_tree, line_chunks, decontaminate, url_model, toxicity, cover_tree, simhash, packing, fill_middle, compression, spelling)


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(module, "ORACLE", {})
    return out
