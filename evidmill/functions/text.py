"""Scalar text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plurals that the token-bounded matcher folds.
PLURALS = {
    "agents": "agent", "ideas": "idea", "proposals": "proposal", "papers": "paper", "tools": "tool",
    "strategies": "strategy", "policies": "policy", "hypotheses": "hypothesis", "researchers": "researcher",
    "teams": "team", "graphs": "graph", "signals": "signal", "systems": "system", "actions": "action",
}


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def all_words(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, in order, with repeats (normalised words; BM25 tokens)."""
    return F.regexp_extract_all(_lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(c: Column) -> Column:
    """Distinct runs of a-z, 0-9 and underscore of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(_lower(c), F.lit("([a-z0-9_]+)"), F.lit(1)))


def comparable_set(c: Column) -> Column:
    """Distinct runs of a-z and 0-9: underscores and hyphens separate."""
    return F.array_distinct(all_words(c))


def normalized(c: Column) -> Column:
    return F.array_join(all_words(c), " ")


def singular(w: Column) -> Column:
    """A word without its last s, if longer than 3 and not ending in ss."""
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w)


def folded_words(c: Column) -> Column:
    """Words in order, plural s folded."""
    return F.transform(all_words(c), singular)


def mapped_words(c: Column) -> Column:
    """Words in order, the plurals of PLURALS replaced."""
    table = F.create_map(*[F.lit(x) for kv in PLURALS.items() for x in kv])
    return F.transform(all_words(c), lambda w: F.coalesce(F.try_element_at(table, w), w))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct ids; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def overlaps(a: Column, b: Column) -> list[Column]:
    """Columns jaccard, intersection_over_min and reason (both_empty, one_empty or null) of two arrays of distinct ids."""
    least = F.least(F.size(a), F.size(b))
    over = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least)
    why = F.when(F.size(a) + F.size(b) == 0, "both_empty").when(least == 0, "one_empty")
    return [F.round(overlap(a, b), 6).alias("jaccard"), F.round(over, 6).alias("intersection_over_min"), why.alias("reason")]


def coverage(query: Column, words: Column) -> Column:
    """Share of a query's distinct words among the words; 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, words)) / F.size(query))


def padded(words: Column) -> Column:
    """Words between single spaces, with a space at both ends: containment of padded phrases is a contiguous match of whole words."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def phrase_in(words: Column, phrase: Column) -> Column:
    """Whether the words of phrase (an array) occur contiguously; an empty phrase doesn't."""
    return (F.size(phrase) > 0) & padded(words).contains(padded(phrase))


def identifier(c: Column) -> Column:
    """DOI and arXiv identifiers without prefix, version suffix and case."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    x = F.regexp_replace(x, r"^(https?://arxiv\.org/abs/|arxiv:\s*)", "")
    return F.regexp_replace(x, r"^([0-9]{4}\.[0-9]{4,5})v[0-9]+$", "$1")


def fixture_text(c: Column, synthetic: Column) -> Column:
    """Normalised text; rows marked synthetic lose their scenario and variant numbers."""
    stripped = F.regexp_replace(normalized(c), r"\b(scenario|variant) [0-9]+\b", "")
    return F.when(synthetic, F.trim(F.regexp_replace(stripped, " +", " "))).otherwise(normalized(c))


def line_ends(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def uniform(*keys: Column) -> Column:
    """Number in [0, 1) that the keys fix: the first 13 hexadecimal digits of their SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
