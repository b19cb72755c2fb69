"""Page jobs: listing records, and books down to the text of their chapters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.functions.text import all_matches, explode_groups, first_match
from tickersift.operators.joins import lookup, lookup_wide
from tickersift.operators.pages import (
    CHAPTER_TEXT,
    CHAPTERS_OF_BOOK,
    FILM_FIELDS,
    FILM_LITERALS,
    LISTED_BOOK,
    LISTED_CHAPTER,
    RANKED_FILM,
    follow_links,
    page_index,
    page_records,
    resolve_url,
)
from tickersift.sinks.tables import write_csv


@dataclass(frozen=True)
class Site:
    """Markup of the four page kinds; link patterns capture the named groups."""

    book: str = LISTED_BOOK
    book_groups: tuple[str, ...] = ("title", "href")
    chapters: str = CHAPTERS_OF_BOOK
    chapter: str = LISTED_CHAPTER
    chapter_groups: tuple[str, ...] = ("href", "title")
    body: str = CHAPTER_TEXT


def film_listing(pages: DataFrame, path: str, encoding: str = "GBK") -> None:
    """Append the records of ranked listing pages to a CSV folder."""
    records = page_records(pages, RANKED_FILM, FILM_FIELDS, literals=FILM_LITERALS)
    write_csv(records.select(*FILM_FIELDS), path, "append", encoding)


def by_url(base: Column, href: Column) -> Column:
    return resolve_url(base, href)


def chapter_texts(
    pages: DataFrame, start: DataFrame, site: Site = Site(), page_address: Column | None = None, link_address=by_url
) -> DataFrame:
    """Book list -> book -> chapter list -> chapter, for every book on the ``start`` pages.

    ``pages`` has page_id, url and html; ``start`` has the page_id of the list pages.
    ``link_address(base, href)`` gives the address a link stands for and
    ``page_address`` the address of a page (its url by default).
    Returns one row per (book, chapter) with the chapter's text. The pages are read twice:
    once for all links, which are written out, and once for the texts of the chapters found.
    """
    extracted = staged(
        pages.select(
            "page_id",
            "url",
            (F.col("url") if page_address is None else page_address).alias("own_address"),
            all_matches(F.col("html"), site.book).alias("books"),
            first_match(F.col("html"), site.chapters).alias("href"),
            all_matches(F.col("html"), site.chapter).alias("chapters"),
        ),
        "page-links",
    )
    index = page_index(extracted, F.col("own_address"))
    address = link_address(F.col("url"), F.col("href"))
    origin = ("page_id", "url")

    lists = extracted.join(start.select("page_id"), "page_id", "left_semi")
    listed = explode_groups(lists, F.col("books"), site.book, site.book_groups, origin)
    books = follow_links(listed, index, address, ["page_id", "pos"]).select(
        F.col("page_id").alias("list_id"),
        F.col("pos").alias("book_pos"),
        F.col("title").alias("book"),
        F.col("target_id").alias("book_id"),
    )

    first_links = extracted.select(*origin, "href").where(F.col("href").isNotNull())
    onward = follow_links(first_links, index, address, ["page_id"]).select(
        F.col("page_id").alias("book_id"), F.col("target_id").alias("chapters_id")
    )
    books = staged(lookup(books, onward, ["book_id"], ["list_id", "book_pos"], how="inner"), "books")

    listed = explode_groups(extracted, F.col("chapters"), site.chapter, site.chapter_groups, origin)
    chapters = follow_links(listed, index, address, ["page_id", "pos"]).select(
        F.col("page_id").alias("chapters_id"),
        F.col("pos").alias("chapter_pos"),
        F.col("title").alias("chapter"),
        F.col("target_id").alias("chapter_id"),
    )
    found = staged(lookup_wide(books, chapters, ["chapters_id"], ["list_id", "book_pos"]), "chapters")

    ids = found.select(F.col("chapter_id").alias("page_id")).distinct()
    texts = pages.join(ids, "page_id", "left_semi").select(
        F.col("page_id").alias("chapter_id"), first_match(F.col("html"), site.body).alias("text")
    )
    return lookup_wide(found, texts, ["chapter_id"], ["list_id", "book_pos", "chapter_pos"])
