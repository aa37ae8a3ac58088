"""Corpus framing audit on Spark: lexicon-driven scoring, source classification,
enrichment, tallies and publication statistics as DataFrame operators."""

from framelens.lexicon import (
    DomainRule,
    GroupPattern,
    Lexicon,
    Override,
    Signal,
    TextRule,
)
from framelens.session import build_session

__all__ = [
    "DomainRule",
    "GroupPattern",
    "Lexicon",
    "Override",
    "Signal",
    "TextRule",
    "build_session",
]
