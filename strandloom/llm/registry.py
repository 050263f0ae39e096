"""All queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from strandloom.llm import bpe, capfilters, crossentropy, divergence, licenses, linededup, mixing, pii, quality, ranking, simhash, toxicity, variants
from strandloom.llm.registry_base import ORACLES, QUERIES

MODULES = (corpus_pipeline, pii, linededup, licenses, toxicity, quality, capfilters, simhash, crossentropy, mixing, bpe, ranking, divergence, variants)


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
