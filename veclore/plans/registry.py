"""All queries of the core, with their SQL twins."""

from veclore.plans import integrity, pipeline, sequences, vectors

MODULES = (integrity, pipeline, sequences, vectors)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
