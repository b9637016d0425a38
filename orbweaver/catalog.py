"""The queries of the engine's own operators and the SQL that checks them."""

from __future__ import annotations

from orbweaver.plans import contents, details, feeds, rules, search, series, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (search, text, rules, series, details, feeds, contents):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
