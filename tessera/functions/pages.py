"""The main text of a page without a model of its layout: the stretch of words between tags that scores most.

A page is a row of words and tags. A word counts for a stretch, a tag against it, and the stretch with the
greatest sum is the text: one pass over the tokens, as a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word and a tag are worth (3.25 words), and parts of a page without text.
WORD, TAG = 4, -13
DROPPED = [r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?is)<head\b.*?</head\s*>", r"(?s)<!--.*?-->"]
TOKEN = r"<[^>]*>|[^<\s]+"


def tokens(html: Column) -> Column:
    """Tags, and words in between, in the order of the page; scripts, styles and comments are left out."""
    shown = F.coalesce(html, F.lit(""))
    for pattern in DROPPED:
        shown = F.regexp_replace(shown, pattern, " ")
    return F.regexp_extract_all(shown, F.lit(TOKEN), F.lit(0))


def _segment(parts: Column) -> Column:
    """First and last place, from 1, of the tokens with the greatest sum; the shortest and then the first of equal ones; last is 0 if there is no word."""
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("sum"), zero.alias("first"), zero.alias("best"), zero.alias("from"), zero.alias("to"))

    def step(s: Column, token: Column) -> Column:
        at, worth = s["at"] + 1, F.when(token.startswith("<"), TAG).otherwise(WORD)
        anew = s["sum"] <= 0
        total, first = F.when(anew, worth).otherwise(s["sum"] + worth), F.when(anew, at).otherwise(s["first"])
        better = total > s["best"]
        ends = (F.when(better, new).otherwise(s[old]).alias(old) for new, old in ((total, "best"), (first, "from"), (at, "to")))
        return F.struct(at.alias("at"), total.alias("sum"), first.alias("first"), *ends)

    return F.aggregate(parts, start, step)


def main_words(html: Column) -> Column:
    """The words of the page's main text; empty without any."""
    def chosen(parts: Column) -> Column:
        found = F.transform(F.array(_segment(parts)), lambda s: F.slice(parts, F.greatest(s["from"], F.lit(1)), s["to"] - F.greatest(s["from"], F.lit(1)) + 1))
        return F.filter(F.get(found, F.lit(0)), lambda t: ~t.startswith("<"))

    # Each is bound within an array, so that a page is taken apart and summed once.
    return F.get(F.transform(F.array(tokens(html)), chosen), F.lit(0))
