"""The queries of this subpackage and their SQL, where SQL can express them."""

from symloom.llm import docs, handmade, leak, level, pack, parses, shared, split

MODULES = [handmade, docs, split, shared, parses, pack, leak, level]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
