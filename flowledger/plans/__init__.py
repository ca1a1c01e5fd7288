"""Registered queries of the dataflow engine, and their SQL."""

from . import cached, contracts, dataflow, engine, evaluation, flagship, scalars

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (flagship, scalars, dataflow, evaluation, engine, cached, contracts):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
