"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rules", "urlfilter", "license_scan", "neardup", "packing", "decontam", "ranker", "warc", "chat", "idcodec", "toxicity", "elkan", "runs")
QUERIES, ORACLE = {}, {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
