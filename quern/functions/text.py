"""Text and scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in a search.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
TOKEN = "[a-z0-9%]+"


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    """Lower-cased tokens of two or more characters, stop words dropped. Null text: null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    words = F.array(*map(F.lit, () if keep_stop_words else STOP_WORDS)).cast("array<string>")
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(words, t))


def normalize(text: Column) -> Column:
    """Edge punctuation stripped, white space collapsed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.btrim(text, F.lit(" -;,.\t\n")), r"\s+", " ")))


def constraint_key(text: Column) -> Column:
    """normalize() without a leading attribute name and colon."""
    return normalize(F.regexp_replace(text, r"(?i)^\s*(material|color|size|style|budget|feature)\s*:\s*", ""))


def constraint_tokens(text: Column) -> Column:
    return F.array_distinct(F.slice(tokens(text), 1, 6))


def ascii_words(pattern: str) -> str:
    r"""A pattern whose \b are the ends of words of ASCII letters, digits and _, as SQL has them: other letters are no part of a word."""
    return pattern.replace(r"\b", "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")


def split_values(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def coarse_category(categories: Column, roots: tuple[str, ...] = ("Parts",), default: str = "item") -> Column:
    """The last two names that aren't roots, joined; default if none is left."""
    kept = F.filter(categories, lambda c: ~c.isin(*roots))
    last = F.when(F.size(kept) >= 2, F.slice(kept, -2, 2)).otherwise(kept)
    return F.when(F.size(kept) > 0, F.lower(F.array_join(last, " "))).otherwise(F.lit(default))


def leaf_category(categories: Column) -> Column:
    return F.coalesce(F.try_element_at(categories, F.lit(-1)), F.lit("__all__"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def price_of(text: Column) -> Column:
    """Price in a text: the upper bound of a range, else a number after under, below, around or a dollar sign."""
    high = F.regexp_extract(text, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*-\s*\$?([0-9]+(?:\.[0-9]+)?)", 2)
    one = F.regexp_extract(text, r"(?i)(?:under|below|around|budget|\$)[^0-9]{0,10}([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.nullif(high, F.lit("")), F.nullif(one, F.lit(""))).cast("double")


#: Attribute classes in their order of precedence, with the words that decide.
CLASSES = (
    ("budget", r"\$|\b(budget|price|under|cheap)\b"),
    ("material", r"\b(cotton|leather|wool|polyester|steel|brass|copper|tin|nickel)\b"),
    ("color", r"\b(black|white|red|blue|green|grey)\b"),
    ("size", r"\b(size|small|medium|large|inch)\b"),
    ("style", r"\b(casual|formal|classic|vintage|old|new)\b"),
    ("use_case", r"\b(hiking|running|office|wedding)\b"),
)


def classify_attribute(text: Column) -> Column:
    out = F.lit("feature")
    for name, pattern in reversed(CLASSES):
        out = F.when(F.lower(text).rlike(ascii_words(pattern)), F.lit(name)).otherwise(out)
    return out


def phrase_in(text: Column, key: Column) -> Column:
    """The key, of 3 to 180 characters, occurs in the text (both lower-cased)."""
    return F.length(key).between(3, 180) & F.contains(text, key)


def token_share(text: Column, words: Column) -> Column:
    """Share of the words that occur in the text as substrings; null without words."""
    return F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0))


def context(text: Column, pattern: str, around: int = 100) -> Column:
    """Up to around characters on both sides of the first match; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    n = F.length(F.regexp_extract(text, pattern, 0))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at + n + around - start))
