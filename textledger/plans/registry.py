"""All queries over the reference's operators, by name, with their DuckDB SQL."""

from . import corpus, history, metrics, scalars, search, snapshots, streams

QUERIES, ORACLES = {}, {}
for part in (scalars, corpus, search, snapshots, history, metrics, streams):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
