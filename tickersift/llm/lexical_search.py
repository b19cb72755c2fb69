"""Ranked lexical search: best-first document intervals over posting lists with range-maximum tables.

The index is a table. Documents are dealt into segments of bounded size where they are
read; within a segment they are placed by length, and each term has one row with the
places and counts of its postings. A further row without a term lists the segment's
documents. The index knows nothing of queries, so it can be written once and searched often.

A search joins the index with the terms that the items ask for, so only those lists move.
In each segment the impacts of a list (all of a score but the weight, which depends on the
term) get a sparse table of range maxima. The maximum over an interval of documents, summed
over an item's terms, bounds every score in it. Intervals are opened best first: the
document with the largest weighted impact is scored, and what lies left and right of it
are two new intervals. When no bound reaches the k-th best score, the rest cannot enter the
result. A step opens many intervals at once, as numpy works on whole arrays.

No segment holds more than ``segment_terms`` terms with repeats, unless one document does;
items are searched in blocks; a group is one block in one segment, so neither a frequent
term nor the number of documents makes a group that grows.

Defined results: NULL texts and texts without a term are not ranked and do not count;
repeated rows are ranked one by one; a NULL id is the last of equal scores; the rows of a
repeated item id are one query, with its smallest text; items without an id, or without a
term, ask nothing; an empty table on either side gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

# The same class twice: for texts, and for UTF-8 bytes that are in lower case already.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
SEGMENT_DOCUMENTS = 65_536
SEGMENT_TERMS = 4_000_000
ITEMS_A_BLOCK = 256
STEP = 256
INDEX = "segment long, term string, documents long, terms long, places binary, counts binary, ids array<long>"


class Numbers(dict):
    """Numbers for keys, in order of their first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def lists_of(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of data between successive bounds, as one binary column."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def segment_rows(segment: int, vocabulary: Numbers, ids: list, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The index rows of one segment: its documents, and a posting list for each term."""
    names = ["segment", "term", "documents", "terms", "places", "counts", "ids"]
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    keys, counts = np.unique((np.concatenate(words).astype(np.int64) << 32) | np.repeat(place, lengths), return_counts=True)
    bounds = np.searchsorted(keys >> 32, np.arange(len(vocabulary) + 1))
    places, counts = (keys & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)
    sorted_lengths = lengths[order].astype(np.int32)
    one = lambda x, kind: pa.array([x], kind)
    yield pa.RecordBatch.from_arrays(
        [
            one(segment, pa.int64()), one(None, pa.string()), one(len(ids), pa.int64()), one(int(lengths.sum()), pa.int64()),
            one(b"", pa.binary()), one(sorted_lengths.tobytes(), pa.binary()), one([ids[i] for i in order], pa.list_(pa.int64())),
        ],
        names,
    )
    terms, n = pa.array(list(vocabulary), pa.binary()).cast(pa.string()), len(vocabulary)
    for at in range(0, n, 10_000):
        cut = slice(at, min(n, at + 10_000))
        own = bounds[cut.start : cut.stop + 1]
        inside = slice(own[0], own[-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(own) - 1, segment)), terms[cut], pa.array(np.diff(own)), pa.array(np.add.reduceat(counts[inside].astype(np.int64), own[:-1] - own[0])),
                lists_of(places[inside], own - own[0]), lists_of(counts[inside], own - own[0]), pa.nulls(len(own) - 1, pa.list_(pa.int64())),
            ],
            names,
        )


def lexical_index(
    docs: DataFrame, segment_documents: int = SEGMENT_DOCUMENTS, segment_terms: int = SEGMENT_TERMS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (segment, term, documents, terms, places, counts, ids) over whole texts; store it before searching it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        vocabulary, ids, words, held = Numbers(), [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = TERM_BYTES.findall((text.as_py() or b"").lower())
                if not found:
                    continue
                ids.append(doc_id)
                words.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= segment_terms or len(ids) >= segment_documents:
                    yield from segment_rows(segment, vocabulary, ids, words)
                    segment, vocabulary, ids, words, held = segment + 1, Numbers(), [], [], 0
        if ids:
            yield from segment_rows(segment, vocabulary, ids, words)

    return docs.select(F.col(id_column).cast("bigint"), F.col(text_column)).mapInArrow(build, INDEX)


class Postings:
    """The lists of one segment behind each other, with a sparse table of range maxima for each."""

    def __init__(self, places: list[np.ndarray], impacts: list[np.ndarray], documents: int):
        self.documents = documents
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        self.places = np.concatenate(places).astype(np.int64)
        self.impacts = np.concatenate([*impacts, [0]]).astype(np.int64)  # the last stands for an empty interval
        self.keys = np.repeat(np.arange(len(places)), np.diff(self.bounds)) * documents + self.places
        n = len(self.places)
        longest = int(np.diff(self.bounds).max())
        self.level_of = np.zeros(longest + 1, np.int64)
        for i in range(1, longest.bit_length()):
            self.level_of[1 << i :] = i
        # Row j, place i: where the maximum of the 2^j postings from i on lies, if they are of one list.
        table = [np.arange(n, dtype=np.int32)]
        for j in range(longest.bit_length() - 1):
            last, right = table[-1], table[-1].copy()
            right[: n - (1 << j)] = last[1 << j :]
            table.append(np.where(self.impacts[last] >= self.impacts[right], last, right))
        self.table, self.n = np.concatenate(table), n

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the largest impact of the postings from low up to high is; n for none."""
        level = self.level_of[high - low]
        row, some = level * self.n, high > low
        low = np.where(some, low, 0)
        a = self.table[row + low]
        b = self.table[row + np.where(some, high - (np.int64(1) << level), 0)]
        return np.where(some, np.where(self.impacts[a] >= self.impacts[b], a, b), self.n)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents and all that tie with the last, and how many were scored."""
        first = lists * self.documents

        def opened(low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
            """Intervals that can reach ``least``: their ends, bounds and the document to split at."""
            at = self.largest(low, high)
            parts = self.impacts[at] * weights
            bound = parts.sum(1)
            keep = np.flatnonzero(bound >= max(least, 1))
            chosen = at[keep, parts[keep].argmax(1)]
            return low[keep], high[keep], bound[keep], self.places[chosen]

        frontier = opened(self.bounds[lists][None, :], self.bounds[lists + 1][None, :], 1)
        found, scores, scored, least = np.empty(0, np.int64), np.empty(0, np.int64), 0, 1
        while len(frontier[2]):
            ahead = np.argpartition(-frontier[2], STEP)[:STEP] if len(frontier[2]) > STEP else np.arange(len(frontier[2]))
            low, high, _, document = (x[ahead] for x in frontier)
            at = np.searchsorted(self.keys, first + document[:, None])
            here = (at < high) & (self.places[np.minimum(at, self.n - 1)] == document[:, None])
            score = (self.impacts[np.where(here, at, self.n)] * weights).sum(1)
            scored += len(document)
            found, scores = np.concatenate([found, document[score > 0]]), np.concatenate([scores, score[score > 0]])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                found, scores = found[scores >= least], scores[scores >= least]
            elif len(scores) == k:
                least = max(least, int(scores.min()))
            fresh = opened(np.concatenate([low, at + here]), np.concatenate([at, high]), least)
            stay = frontier[2] >= least
            stay[ahead] = False
            frontier = tuple(np.concatenate([x[stay], y]) for x, y in zip(frontier, fresh, strict=True))
        return found, scores, scored


def impacts_of(counts: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a score has of one posting, but for the weight of the term."""
    m = 75 + (25 * lengths.astype(np.int64) * documents) // terms
    counts = counts.astype(np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (item, term, repeats)."""
    lowered = F.translate(F.col(text_column), string.ascii_uppercase, string.ascii_lowercase)
    asked = items.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    asked = asked.select(F.col(id_column).alias("item"), lowered.alias("text"), F.col(text_column).alias("raw"))
    asked = asked.groupBy("item").agg(F.min_by("text", "raw").alias("text"))
    terms = asked.select("item", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item", "term").agg(F.count("*").alias("repeats"))


def lexical_search(
    index: DataFrame, items: DataFrame, k: int = 20, block_items: int = ITEMS_A_BLOCK, id_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each item the k documents with the largest score above 0.

    ``index`` is a stored table that ``lexical_index`` made.
    """
    kind = items.schema[id_column].dataType.simpleString()
    documents, terms = index.where(F.col("term").isNull()).agg(F.sum("documents"), F.sum("terms")).first()
    if not documents:
        return items.sparkSession.createDataFrame([], f"{id_column} {kind}, rank int, doc_id long, score long")
    asked = staged(item_terms(items, id_column, text_column), "item-terms")
    blocks = max(1, -(-asked.select("item").distinct().count() // block_items))
    lists = index.where(F.col("term").isNotNull())
    frequent = lists.select("term", "documents").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("documents").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighed = asked.join(frequent, "term").select("term", "item", (weight * F.col("repeats")).alias("weight")).where("weight > 0")
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    # One row per block and term, with as many entries as a block has items.
    entries = staged(weighed.groupBy("term", block).agg(F.collect_list(F.struct("item", "weight")).alias("entries")), "item-weights")
    wanted = lists.select("segment", "term", "places", "counts").join(entries, "term")
    wanted = wanted.select("segment", "block", "term", "places", "counts", F.lit(None).cast("array<long>").alias("ids"), "entries")
    every = index.where(F.col("term").isNull()).select(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "places", "counts", "ids",
        F.lit(None).cast(entries.schema["entries"].dataType).alias("entries"),
    )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        head = pc.index(pc.is_null(table.column("term")), True).as_py()
        rows = table.filter(pc.is_valid(table.column("term"))).combine_chunks()
        parts = []
        if rows.num_rows:
            lengths = np.frombuffer(table.column("counts")[head].as_py(), np.int32)
            ids = table.column("ids")[head].values
            places = [np.frombuffer(x.as_py(), np.int32) for x in rows.column("places")]
            counts = [np.frombuffer(x.as_py(), np.int32) for x in rows.column("counts")]
            postings = Postings(places, [impacts_of(c, lengths[p], documents, terms) for p, c in zip(places, counts, strict=True)], len(lengths))
            entries = rows.column("entries").combine_chunks()
            of_list = pc.list_parent_indices(entries).to_numpy()
            entries = entries.flatten()
            items = entries.field(0).dictionary_encode()
            item, weights = items.indices.to_numpy(), entries.field(1).to_numpy()
            for number, name in enumerate(items.dictionary):
                own = np.flatnonzero(item == number)
                found, scores, _ = postings.best(of_list[own], weights[own], k)
                # Of equal scores the smaller ids, and at last those without one.
                chosen = pa.table({"score": pa.array(scores), "doc_id": ids.take(pa.array(found))})
                chosen = chosen.take(pc.sort_indices(chosen, [("score", "descending"), ("doc_id", "ascending")])).slice(0, k)
                parts.append(pa.table({id_column: pa.repeat(name, chosen.num_rows), "doc_id": chosen["doc_id"], "score": chosen["score"]}))
        empty = pa.table({id_column: pa.array([], rows.schema.field("entries").type.value_type.field(0).type), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.concat_tables([empty, *parts])

    found = wanted.unionByName(every).groupBy("segment", "block").applyInArrow(search, f"{id_column} {kind}, doc_id long, score long")
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(id_column, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index ``docs``, whole texts of all rows, and search the index for every item."""
    return lexical_search(staged(lexical_index(docs), "lexical-index"), items, k)
