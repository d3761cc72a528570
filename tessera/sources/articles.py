"""Articles of encyclopedias and of the press as passages: how many an article gives, and how many a source keeps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as shaping
from tessera.sources import payloads

#: Articles that a query reads of each source.
ARTICLES = 2
# Languages that are asked first.
PREFERRED = ["en", "fr", "de", "pt", "it"]


@dataclass(frozen=True)
class Kind:
    """A source of articles: passages of an article, passages kept, whether these are ranked again, and how its texts come."""

    name: str
    each: int
    most: int
    again: bool = False
    rendered: bool = False  # markup, of which so many characters are read if there are enough
    head: int = 8000
    least: int = 40


# What each source gives.
KINDS = [Kind("wikipedia", 4, 4, again=True), Kind("wikinews", 2, 3), Kind("wikiquote", 2, 3), Kind("wikisource", 2, 3, rendered=True), Kind("wiktionary", 1, 2)]


def passages(articles: DataFrame, key: str, kinds: list[Kind] | None = None) -> DataFrame:
    """key, source, rank, article, place, score, passage of articles (key, article, query, text); article: its number for the query, from 1.

    An article's passages are ranked by the query's words that they have; a source takes the first of each article, one article
    after the other (the best of all if it ranks again), and keeps the first ones. All within the few rows of a query.
    """
    rows = articles.where(F.col("article") <= ARTICLES)
    parts = []
    for kind in KINDS if kinds is None else kinds:
        body = F.substring(shaping.strip_markup(F.col("text")), 1, kind.head) if kind.rendered else F.col("text")
        own = rows.where(F.length(shaping.strip_markup(F.col("text"))) >= kind.least) if kind.rendered else rows
        best = F.slice(payloads.scored_passages(F.col("query"), body), 1, kind.each)
        each = own.select(key, "article", F.posexplode(best).alias("turn", "p")).select(key, "article", "turn", "p.*")
        order = [F.col("worse"), F.col("article"), F.col("turn")] if kind.again else [F.col("article"), F.col("turn")]
        ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= kind.most)
        parts.append(ranked.select(key, F.lit(kind.name).alias("source"), "rank", "article", "place", (-F.col("worse")).alias("score"), "passage"))
    return reduce(DataFrame.unionByName, parts)


def language_rank(lang: Column) -> Column:
    place = F.array_position(F.lit(PREFERRED), lang)
    return F.when(place == 0, 99).otherwise(place)


def in_other_languages(links: DataFrame, key: str, own: str = "es", languages: int = 5, each: int = 2) -> DataFrame:
    """key, lang, rank, place, passage of links (key, lang, text): the article in other languages, preferred ones first, its first passages in order."""
    others = links.where(F.col("lang") != own)
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(language_rank(F.col("lang")), "lang"))).where(F.col("rank") <= languages)
    return ranked.select(key, "lang", "rank", F.posexplode(F.slice(shaping.pack(F.col("text")), 1, each)).alias("place", "passage"))


# What a press index answers: a list of articles with addresses and titles.
LISTED = "articles array<struct<url:string,title:string>>"


def listed(payload: Column, read: int = 2) -> Column:
    """The first pages to read of a press index's answer; entries without an address do not count."""
    return F.slice(F.filter(F.from_json(payload, LISTED)["articles"], lambda a: F.coalesce(a["url"], F.lit("")) != ""), 1, read)
