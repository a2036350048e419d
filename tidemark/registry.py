"""Registered queries: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from .plans import briefings, exports, history, landed, products, quality_queries, scalars

QUERIES: dict = {**scalars.QUERIES, **products.QUERIES, **quality_queries.QUERIES, **landed.QUERIES, **briefings.QUERIES, **history.QUERIES, **exports.QUERIES}
ORACLES: dict = {**scalars.ORACLES, **products.ORACLES, **quality_queries.ORACLES, **landed.ORACLES, **briefings.ORACLES, **history.ORACLES, **exports.ORACLES}
