"""All queries of the engine's own operators, by name, with the SQL that must give the same rows."""

from . import geometry, graphs, linear, sequences, sets, sources, spatial, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (sequences, sets, graphs, texts, geometry, spatial, linear, sources):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
