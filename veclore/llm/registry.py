"""All queries of this subpackage, with their SQL twins where SQL can express them."""

from veclore.llm import plans_corpus, plans_records, plans_text, plans_vectors

MODULES = (plans_corpus, plans_records, plans_text, plans_vectors)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
