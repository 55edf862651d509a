"""All queries of the engine with their checking SQL."""

from __future__ import annotations

from leafmill.plans import pages, records, scalars, tables

QUERIES = {**scalars.QUERIES, **tables.QUERIES, **pages.QUERIES, **records.QUERIES}
ORACLES = {**scalars.ORACLES, **tables.ORACLES, **pages.ORACLES, **records.ORACLES}
