"""The registered queries of this engine's operators, with their SQL."""

from . import display, models, records, relational, stored, streams, vectors

QUERIES: dict = {}
ORACLES: dict = {}
for module in (relational, vectors, models, streams, records, display, stored):
    QUERIES |= module.registry.queries
    ORACLES |= module.registry.oracles
