"""Full-text tokens and needles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of word characters; runs joined by . @ : / - are tokens as a whole too.
COMPOUND = r"[^a-z0-9_.@:/-]+"
SIMPLE = r"[^a-z0-9_]+"


def token_array(text: Column) -> Column:
    """Distinct lower-cased tokens: compounds such as hosts, addresses and paths, and their parts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.array_distinct(F.concat(F.split(low, COMPOUND), F.split(low, SIMPLE))), "")


def needle_tokens(needle: str) -> list[str]:
    return [t for t in re.split(COMPOUND, needle.lower()) if t]


def has_all(tokens: Column, needle: str) -> Column:
    """All tokens of the needle are present; a needle without tokens matches nothing."""
    out = None
    for t in needle_tokens(needle):
        one = F.array_contains(tokens, t)
        out = one if out is None else out & one
    return F.lit(False) if out is None else out


def web_search(tokens: Column, phrase: str) -> Column:
    """A search form's needle: words are ANDed, "or" separates alternatives, a leading - excludes, quotes group words."""
    any_of, all_of = None, None
    for part in re.findall(r'-?"[^"]*"|\S+', phrase):
        if part.lower() == "or":
            if all_of is not None:
                any_of = all_of if any_of is None else any_of | all_of
            all_of = None
            continue
        one = has_all(tokens, part.strip('-"'))
        one = ~one if part.startswith("-") else one
        all_of = one if all_of is None else all_of & one
    if all_of is not None:
        any_of = all_of if any_of is None else any_of | all_of
    return F.lit(False) if any_of is None else any_of


def glob_to_like(pattern: str) -> str:
    """* and ? as LIKE wildcards; LIKE's own are escaped by a backslash."""
    escaped = re.sub(r"([\\%_])", r"\\\1", pattern)
    return escaped.replace("*", "%").replace("?", "_")
