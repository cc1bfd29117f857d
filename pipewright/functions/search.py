"""Full-text search: English terms of a text as Column expressions, and of a query on the driver."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem

# English stop words.
STOP = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your yours yourself yourselves"
).split()
_WORD = r"[\p{L}\p{N}]"


def terms(query: str) -> list[str]:
    """Distinct stems of a query's words that are no stop words."""
    return list(dict.fromkeys(stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP))


def _begins(term: str) -> str:
    """What every word with this stem begins with: stemming changes two letters before the suffix at most."""
    return term[: max(1, len(term) - 2)]


def _has_all(own: tuple[str, ...]):
    @F.pandas_udf("boolean")
    def run(words: pd.Series) -> pd.Series:
        return pd.Series([some is not None and set(own) <= set(map(stem, some)) for some in words], dtype=bool)

    return run


def matches(texts: list[Column], query: str) -> Column:
    """Whether the texts together hold every term of the query; nulls count as empty.

    Built-in expressions find the rows that hold a word with each term's beginning, and those words; only they are stemmed.
    """
    own = terms(query)
    if not texts or not own:
        return F.lit(False)
    whole = F.lower(F.concat_ws(" ", *texts))
    word = lambda parts: rf"(?<!{_WORD})(?:{'|'.join(parts)})"
    begins = sorted({re.escape(_begins(t)) for t in own})
    near = reduce(lambda a, b: a & b, [whole.rlike(word([b])) for b in begins])
    return near & _has_all(tuple(own))(F.regexp_extract_all(whole, F.lit(f"({word(begins)}{_WORD}*)"), F.lit(1)))
