"""Keyword rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..fixed_values import AI_KEYWORDS, BIO_KEYWORDS, STRONG_KEYWORDS
from .text import text_or_empty


def _pattern(keywords) -> str:
    words = [re.escape(k.strip().lower()) for k in keywords if re.fullmatch("[a-z0-9]+", k.strip().lower())]
    phrases = [re.escape(k.strip().lower()) for k in keywords
               if k.strip() and not re.fullmatch("[a-z0-9]+", k.strip().lower())]
    options = [f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"] if words else []
    return "|".join(options + phrases) or "(?!)"


def on_topic(title, summary, ai=AI_KEYWORDS, bio=BIO_KEYWORDS, strong=STRONG_KEYWORDS) -> Column:
    """One keyword of each of the first two lists, or one of the strong list."""
    text = F.lower(F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(summary)))
    return (text.rlike(_pattern(ai)) & text.rlike(_pattern(bio))) | text.rlike(_pattern(strong))
