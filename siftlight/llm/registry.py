"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, centroids, chat, embeddings, language, lattice, minhash, packing, quality, recompression, sharding, suffixes, warc

_MODULES = (quality, packing, recompression, lattice, language, chat, warc, embeddings, minhash, suffixes, audit, sharding, centroids)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in getattr(m, "ORACLE", {}).items()}
