"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, license_scan, packing, piece_sampling, quality_classifier, quality_rules, simhash, token_files, toxicity, url_reputation

_MODULES = (toxicity, simhash, license_scan, packing, quality_rules, piece_sampling, exact_dedup, url_reputation, token_files, quality_classifier)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
