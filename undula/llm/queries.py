"""The queries of this subpackage, and SQL for those that SQL can express."""

from undula.llm import alignment, ann, decontaminate, embedding_dups, hard_negatives, licences, line_dedup, packing, pii, quality, secrets, simhash, token_output

_MODULES = (simhash, secrets, packing, quality, ann, line_dedup, token_output, licences, decontaminate, pii, alignment, embedding_dups, hard_negatives)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
