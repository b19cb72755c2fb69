"""Line dedup by a log-template tree, in DataFrame functions only.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its leading
tokens, to a leaf. Tokens with a digit are variable fields and become ``<*>``. Within a
leaf the other variable fields are generalised too: a position keeps its token only if
half of the leaf's occurrences have it there, and lines that agree with a mostly constant
template on all its constants belong to it. A template that recurs in enough documents
is dropped from all of them but the first (smallest id), so a group of copies keeps one
whole member; what is lost are the other values of variable fields. By default a template
may have no constant at all; see ``words``. Short lines recur by chance, so they need more documents.

A document is an id with a text, so repeated rows are one document, and all get the same
result. Only hashes and counts of lines are shuffled, and texts once, to be rewritten.

Defined results: NULL and empty texts have no lines and stay as they are; blank lines
are kept; very long texts are split like any other; a NULL id is the smallest; an empty
table gives an empty result; all other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

SPACES = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
KEY = ("k1", "k2")


def evenly_spaced(text: Column) -> Column:
    """The text with one blank between the tokens of a line and none around them.

    Most texts are so already, which plain searches for the exceptions find out.
    """
    blanks = r"[\x20\x09\x0B-\x0D]"
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for exception in ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(text, F.lit(exception))
    trimmed = F.regexp_replace(text, f"(?dm)^{blanks}+|{blanks}+$", "")
    return F.when(odd, F.regexp_replace(trimmed, rf"\x20{blanks}+|[\x09\x0B-\x0D]{blanks}*", " ")).otherwise(text)


def line_template(line: Column, words: float) -> Column:
    """The line with tokens that have a digit as fields, unless less than the share ``words`` of its tokens have none.

    String functions on lines stay within generated code, as functions on arrays of tokens do not.
    """
    # Only at the start of a token, so each is looked at once.
    masked = F.regexp_replace(line, r"(?<![^ ])[^0-9 ]*+[0-9][^ ]*+", FIELD)
    digits = line.rlike("[0-9]")
    if not words:
        return F.when(digits, masked).otherwise(line)
    fields = F.regexp_count(masked, F.lit(r"(?<![^ ])<\*>(?![^ ])"))
    return F.when(digits & (token_count(line) - fields >= words * token_count(line)), masked).otherwise(line)


def token_count(template: Column) -> Column:
    blanks = F.length(template) - F.length(F.replace(template, F.lit(" "), F.lit("")))
    return F.when(template == "", 0).otherwise(blanks + 1)


def document_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(1)).alias("k2")]


def _templates(docs: DataFrame, words: float) -> DataFrame:
    """One row per line that is not blank, with its template."""
    rows = docs.select(*KEY, "id", F.posexplode(F.split(evenly_spaced(F.col("text")), "\n")).alias("no", "line")).where(F.col("line") != "")
    return rows.select(*KEY, "id", "no", line_template(F.col("line"), words).alias("template")).withColumn("n", token_count(F.col("template")))


def _leaf(depth: int) -> Column:
    return F.xxhash64("n", F.substring_index("template", " ", depth)).alias("leaf")


def _template_key() -> list[Column]:
    return [F.xxhash64("template").alias("t1"), F.xxhash64(F.lit(1), "template").alias("t2")]


def _lines(docs: DataFrame, depth: int, words: float) -> DataFrame:
    """One row per line that is not blank, with the hashes of its leaf and of its template."""
    return _templates(docs, words).select(*KEY, "id", "no", "n", _leaf(depth), *_template_key())


def _generalised(lines: DataFrame, docs: DataFrame, depth: int, enough: Column, constant: float, several: bool, words: float) -> DataFrame:
    """Rows (t1, t2, general): templates that a general template of their leaf covers.

    With ``several``, templates that the leaf's main one does not cover are grouped by
    those of their tokens that ``enough`` lines of the leaf have at that place.
    Only leaves with several templates and enough documents are looked at, and only their
    lines' tokens are counted, by position.
    """
    templates = lines.where(F.col("n") > depth).groupBy("leaf", "n", "t1", "t2").agg(F.count("*").alias("lines"))
    leaves = templates.groupBy("leaf", "n").agg(F.sum("lines").alias("all"), F.count("*").alias("kinds"))
    leaves = staged(leaves.where((F.col("kinds") > 1) & (F.col("all") >= enough)).drop("n"), "leaves")
    # Texts are read again, since few templates are of such a leaf; only theirs are split into tokens, one of each kind.
    members = _templates(docs, words).select("template", "n", _leaf(depth)).join(leaves, "leaf")
    kinds = members.groupBy("leaf", "all", "n", "template").agg(F.count("*").alias("lines"))
    kinds = staged(kinds.select("leaf", "all", *_template_key(), "n", F.split("template", " ").alias("tokens"), "lines"), "leaf-lines")
    places = kinds.select("leaf", "all", "t1", "t2", "n", "lines", F.posexplode("tokens").alias("at", "token"))
    fixed = places.where(F.col("token") != FIELD).groupBy("leaf", "all", "n", "at", "token").agg(F.sum("lines").alias("lines"))
    fixed = fixed.where(2 * F.col("lines") > F.col("all")).select("leaf", "n", "at", "token")
    general = fixed.groupBy("leaf", "n").agg(F.count("*").alias("constants"))
    general = general.where(F.col("constants") >= constant * F.col("n")).select("leaf", "constants")
    agreeing = places.join(fixed.drop("n"), ["leaf", "at", "token"]).groupBy("leaf", "t1", "t2").agg(F.count("*").alias("agree"))
    main = agreeing.join(general, "leaf").where(F.col("agree") == F.col("constants")).select("t1", "t2", F.col("leaf").alias("general"))
    if not several:
        return main
    main = staged(main, "main-templates")
    others = places.where(F.col("token") != FIELD).join(main, ["t1", "t2"], "left_anti")
    frequent = others.groupBy("leaf", "n", "at", "token").agg(F.sum("lines").alias("found")).where(F.col("found") >= enough)
    kept = others.join(frequent.drop("found", "n"), ["leaf", "at", "token"])
    grouped = kept.groupBy("leaf", "t1", "t2", "n").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("tokens"))
    grouped = grouped.where(F.size("tokens") >= constant * F.col("n"))
    return main.unionByName(grouped.select("t1", "t2", F.xxhash64("leaf", "tokens").alias("general")))


def drop_recurring_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_docs_long: int = 3,
    long_tokens: int = 20,
    depth: int = 3,
    constant: float = 0.7,
    several: bool = False,
    leaf_lines_long: int | None = None,
    words: float = 0.0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``row`` (a struct of all columns), text, n_lines and n_dropped.

    A template recurs if it is in ``min_docs`` documents, or in ``min_docs_long`` if it
    has ``long_tokens`` tokens or more. With ``several``, a leaf may have more than one
    general template. A leaf is generalised from ``min_docs`` lines on, or from
    ``leaf_lines_long`` if it is given and the lines are long. A line with a smaller share
    of tokens without digits than ``words`` is compared by its own text.
    """
    doc_id, text = F.col(id_column), F.col(text_column)
    narrow = docs.select(doc_id.alias("id"), text.alias("text"), *document_key(doc_id, text))
    lines = staged(_lines(narrow, depth, words), "lines")
    leaf_lines = F.when(F.col("n") >= long_tokens, min_docs if leaf_lines_long is None else leaf_lines_long).otherwise(min_docs)
    general = staged(_generalised(lines, narrow, depth, leaf_lines, constant, several, words), "general-templates")
    placed = lines.join(general, ["t1", "t2"], "left").select(
        *KEY, "id", "no", "n", F.coalesce("general", "t1").alias("p1"), F.when(F.col("general").isNull(), F.col("t2")).otherwise(F.col("n")).alias("p2")
    )
    per_document = placed.groupBy("p1", "p2", *KEY).agg(F.first("id").alias("id"), F.first("n").alias("n"))
    seen = per_document.groupBy("p1", "p2").agg(
        F.count("*").alias("documents"), F.min(F.struct("id", *KEY)).alias("first"), F.first("n").alias("n")
    )
    enough = F.when(F.col("n") >= long_tokens, min_docs_long).otherwise(min_docs)
    recurring = staged(seen.where(F.col("documents") >= enough).select("p1", "p2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")), "recurring")
    other = (F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2"))
    drops = placed.join(recurring, ["p1", "p2"]).where(other).select(*KEY, "no")
    # In a set a document's line numbers stay few and small; repeated rows merge before the shuffle.
    dropped = drops.groupBy(*KEY).agg(F.sort_array(F.collect_set("no")).alias("drop"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *document_key(doc_id, text))
    joined = keyed.join(dropped, list(KEY), "left")
    body = F.col("row")[text_column]
    all_lines = F.split(body, "\n")
    rest = F.array_join(_without(all_lines, F.col("drop")), "\n")
    changed = F.col("drop").isNotNull()
    return joined.select(
        "row",
        F.when(changed, rest).otherwise(body).alias("text"),
        F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"),
    )


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` without the sorted positions ``drop``: the slices between them, in linear time."""
    ends = F.concat(drop, F.array(F.size(lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(drop, lambda i: i + 1))
    return F.flatten(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda s: F.slice(lines, s["b"] + 1, s["e"] - s["b"])))
