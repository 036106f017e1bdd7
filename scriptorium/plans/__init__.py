"""Registered queries and the SQL that checks them."""

from . import exam, grounding, index, library, more, retrieval, study

_PARTS = (retrieval, study, library, more, exam, index, grounding)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: query for part in _PARTS for name, query in part.ORACLES.items()}
