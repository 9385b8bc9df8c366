"""All registered queries and their SQL checks."""

from shellfield.queries import distance, ingest, learning, quality, structure

QUERIES = {}
ORACLES = {}
for module in (distance, structure, ingest, quality, learning):
    QUERIES.update(module.registry.queries)
    ORACLES.update(module.registry.oracles)
