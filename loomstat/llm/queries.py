"""The queries of this subpackage and their SQL."""

from . import chat, collocations, decontaminate, language_id, line_dedup, mixing, pii, quality, retention, simhash, suffix_dedup, toxicity, url_filter

_MODULES = (url_filter, pii, quality, decontaminate, mixing, suffix_dedup, toxicity, simhash, language_id, line_dedup, retention, collocations, chat)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
