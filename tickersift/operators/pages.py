"""Extraction from HTML pages and link following."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.text import explode_matches, first_match, pattern
from tickersift.operators.joins import lookup

# Markup of the known page kinds.
LISTED_BOOK = pattern(r'<a target="_blank" title="(.*?)" href="(.*?)" class="clearfix stitle">')
CHAPTERS_OF_BOOK = pattern(r'<a href="(.*?)"  class="l mr11">')
LISTED_CHAPTER = pattern(r'<li><a href="(.*?)" title=".*?">(.*?)</a></li>')
CHAPTER_TEXT = pattern(r'style5\(\);</script>(.*?)<script type="text/javascript">', across_lines=True)
RANKED_FILM = pattern(
    r'<dd>.*?board-index.*?>(.*?)</i>.*?name.*?><a.*?>(.*?)</a>.*?star.*?>(.*?)</p>.*?releasetime.*?>(.*?)</p>'
    r'.*?score.*?><i class="integer">(.*?)</i><i.*?fraction.*?>(.*?)</i>.*?</dd>',
    across_lines=True,
)
FILM_LITERALS = ("board-index", "releasetime", '<i class="integer">', "fraction")
FILM_FIELDS = ("Index", "Name", "Actor", "Time", "Score", "Float")


def page_links(
    pages: DataFrame, regex: str, names: Sequence[str] = ("href", "title"), keep: Sequence[str] = ("page_id",)
) -> DataFrame:
    """One row per link: the page's ``keep`` columns, the link's position and the captured groups."""
    return explode_matches(pages, "html", regex, names, keep)


def page_records(
    pages: DataFrame,
    regex: str,
    names: Sequence[str],
    keep: Sequence[str] = ("page_id",),
    literals: Sequence[str] = (),
) -> DataFrame:
    """One row per listing entry; the regex may span lines.

    ``literals`` are texts that every match contains. A page without one of them is not
    searched: a regex with many lazy parts is slowest where it fails.
    """
    likely = pages.where(reduce(and_, [F.col("html").contains(t) for t in literals])) if literals else pages
    return explode_matches(likely, "html", regex, names, keep)


def page_first_match(pages: DataFrame, regex: str, name: str, key: str = "page_id") -> DataFrame:
    """The first match in each page; NULL where there is none."""
    return pages.select(key, first_match(F.col("html"), regex).alias(name))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(path == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(folder, href))
    )


def page_index(pages: DataFrame, address: Column, key: str = "page_id") -> DataFrame:
    """Address -> page; the smallest key wins where pages share an address."""
    return (
        pages.select(address.alias("address"), key)
        .where(F.col("address").isNotNull())
        .groupBy("address")
        .agg(F.min(key).alias("target_id"))
    )


def follow_links(links: DataFrame, index: DataFrame, address: Column, spread: Sequence[str]) -> DataFrame:
    """Add the page that each link leads to; links that lead nowhere are dropped.

    Navigation links make some targets very frequent, so the join is spread.
    """
    return lookup(links.withColumn("address", address), index, ["address"], spread, how="inner").drop("address")
