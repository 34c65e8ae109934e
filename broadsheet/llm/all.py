"""Imports every module that registers queries; raises ImportError where a part is missing."""

from . import (  # noqa: F401
    align, archives, bpe, chat, decontaminate, jaccard, lexical, licences, quality, sharding, simhash, suffixes,
    topk)
from .registry import ORACLE, QUERIES  # noqa: F401
