"""Terms of a task's wording, as hints for ranking evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import looks_like_question, ordered_distinct

# Words that are no terms.
NO_TERMS = (
    "the and for to your you need navigate module application where contains create complete following steps concretely "
    "a an or of in on at by with without from is are was were be been being has have had do does did not that this these those "
    "which what when who whom whose why how tell find input image below local path posixpath url https http me my our"
).split()
# Openings of addresses and paths, which are no terms either.
NO_OPENINGS = ("http://", "https://", "posixpath(")

_QUOTED = r"[\"'“”]([^\"'“”]{3,80})[\"'“”]"
_NAMES = r"\b[A-Z][A-Za-z0-9&.-]+(?:\s+[A-Z][A-Za-z0-9&.-]+){0,5}\b"
_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.@-]{2,}"


def _tidy(term: Column) -> Column:
    """White space collapsed, separators at the ends removed."""
    return F.regexp_replace(F.regexp_replace(term, r"(?U)\s+", " "), r"^[ :;,.>-]+|[ :;,.>-]+$", "")


def _is_term(term: Column) -> Column:
    low, opens = F.lower(term), F.lit(False)
    for start in NO_OPENINGS:
        opens = opens | low.startswith(start)
    return (F.length(term) >= 3) & ~low.isin(NO_TERMS) & ~opens & ~looks_like_question(term)


def goal_terms(text: Column, most: int = 24) -> Column:
    """Quoted spans, parts of a path, capitalised phrases, then words that none of these holds; without repeats.

    No term is a question, an address or a stop word. A null text has no terms.
    """
    text = F.coalesce(text, F.lit(""))
    part = lambda p: F.regexp_replace(p, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    parts = F.filter(F.transform(F.split(text, "[>/→]"), part), lambda p: F.length(p).between(3, 80) & p.rlike(r"\p{Lu}") & ~p.rlike("[\"']") & ~looks_like_question(p))
    spans = F.concat(F.regexp_extract_all(text, F.lit(_QUOTED), 1), parts, F.regexp_extract_all(text, F.lit(_NAMES), 0))
    phrases = ordered_distinct(F.filter(F.transform(spans, _tidy), _is_term))
    # bound once: the words of all phrases are looked up for each token
    bound = F.array(F.struct(phrases.alias("phrases"), F.flatten(F.transform(phrases, lambda p: F.split(F.lower(p), " "))).alias("held")))
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), 0)

    def both(b: Column) -> Column:
        fresh = F.filter(tokens, lambda t: ~F.lower(t).isin(NO_TERMS) & ~F.array_contains(b["held"], F.lower(t)))
        return F.concat(b["phrases"], F.filter(F.transform(fresh, _tidy), _is_term))

    return F.slice(ordered_distinct(F.get(F.transform(bound, both), F.lit(0))), 1, most)
