"""Queries of this subpackage and their SQL, by name."""

from . import bpe, divergence, embeddings, language, lm_score, mixing, ngram_join, positions, quality, token_counts, toxicity, urls, whitening

MODULES = (bpe, mixing, ngram_join, urls, language, quality, toxicity, token_counts, lm_score, embeddings, positions, divergence, whitening)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
