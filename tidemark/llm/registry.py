"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, mixing, packing, quality_classifier, quality_rules, secret_scans, simhash, substring_dedup, url_filters, warc

MODULES = (quality_classifier, simhash, secret_scans, ann, warc, url_filters, mixing, quality_rules, packing, substring_dedup)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
