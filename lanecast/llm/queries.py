"""All queries of this subpackage and their SQL."""

from lanecast.llm import decontaminate, exact_dedup, langid, licenses, lm_score, manifest, media, mixing, near_dups, packing, resample, secrets, tokens

MODULES = (tokens, media, licenses, langid, packing, lm_score, exact_dedup, near_dups, mixing, secrets, manifest, decontaminate, resample)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
