"""The registered queries of this subpackage and their SQL."""

from . import chat, fingerprint, langid, mixing, ngram_join, packing, pii, quality, substrings, warc

_MODULES = (ngram_join, substrings, quality, langid, packing, fingerprint, pii, warc, mixing, chat)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
