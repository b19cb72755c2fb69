"""Spelling variants: a trie of letter-group counts, searched with a surplus and a deficit of one each.

The letters of the vocabulary are dealt into ``GROUPS`` groups of about equal frequency. A
word's counts by group, one after the other, are its way down a trie; words with the same
counts share a leaf. One inserted, deleted or replaced code point adds at most one to one
count and takes at most one from another, so a search goes down every branch that a surplus
of one and a deficit of one allow, and the words of the leaves it reaches are verified.

The trie is cut where a subtree has at most ``subtree_words`` words, and its top, above the
cut, is walked in joins, a level at a time: a word's search moves to the child nodes its
budget allows, until it meets a subtree. Each subtree is then searched in one task, by at
most ``part_queries`` words at once; a leaf that is larger than a subtree may be is split by
a hash. Only counts, by node, leave the words.

Defined results: a NULL text has no words; a NULL id counts as an empty one where words are
altered by id; repeated rows count each; words of any length are compared whole; among near
words with equal counts the smallest in code-point order is the form; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

# Every letter that counts is one byte in Latin-1, so byte order is code-point order.
RUN = re.compile(rb"[A-Za-z\xC0-\xFF]+")
GROUPS = 16
# Words counted in a task before they are passed on.
HELD_WORDS = 500_000
# Words up to this length are verified as rows of a matrix, longer ones pair by pair.
MATRIX_WIDTH = 48
BLOCK_QUERIES = 2048
BLOCK_PAIRS = 500_000


def altered(word: bytes, id_crc: int, every: int) -> bytes:
    """The word, or without one of its code points if ``every`` divides the checksum of id and word."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), id_crc)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(
    docs: DataFrame, min_letters: int = 6, min_count: int = 5, every: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (word, n) of whole texts, A-Z in lower case; with ``every``, one run in so many loses a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Counter(RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower()))
                crc = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in runs.items():
                    if len(word) >= min_letters:
                        if every:
                            word = altered(word, crc, every)
                            if len(word) < min_letters:
                                continue
                        total[word] += n
            if len(total) > HELD_WORDS:
                yield rows()
                total.clear()
        yield rows()

    counted = docs.select(F.col(id_column).cast("string"), F.col(text_column)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """The group of each letter: the most frequent ones apart, every further one to the lightest group."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(256, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(found)], ["letter", "n"])

    counts = words.select("word").mapInArrow(letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # 256 rows
    weight, group = [0] * groups, np.zeros(256, np.int64)
    for r in sorted(counts, key=lambda r: (-r["n"], r["letter"])):
        group[r["letter"]] = lightest = weight.index(min(weight))
        weight[lightest] += r["n"]
    return group


def group_counts(words: list[bytes], group: np.ndarray, groups: int) -> np.ndarray:
    """One row of counts a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = group[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(np.repeat(np.arange(len(words)), lengths) * groups + letters, minlength=len(words) * groups).reshape(-1, groups)


def with_counts(words: DataFrame, group: np.ndarray, groups: int) -> DataFrame:
    """(word, n, counts)"""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = group_counts([w.encode("latin-1") for w in batch.column(0).to_pylist()], group, groups).astype(np.int32)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, groups, dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["word", "n", "counts"])

    return words.select("word", "n").mapInArrow(count, "word string, n long, counts array<int>")


def walk_top(words: DataFrame, groups: int, subtree_words: int) -> tuple[DataFrame, DataFrame]:
    """Cut the trie into subtrees: (subtree, level, word, n, counts), and who searches them: (subtree, word, counts, surplus, deficit).

    A subtree is named by the counts that lead to it. The number of rounds is at most the
    number of groups, whatever the number of words.
    """
    inside = words.select("word", "n", "counts", F.lit("").alias("node"))
    searching = words.select("word", "counts", F.lit("").alias("node"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    placed, asked = [], []
    for level in range(groups + 1):
        sizes = staged(inside.groupBy("node").agg(F.count("*").alias("size")), "trie-level")
        small = F.col("size") <= subtree_words if level < groups else F.lit(True)
        sized, met = inside.join(sizes, "node"), searching.join(sizes, "node")
        placed.append(sized.where(small).select(F.col("node").alias("subtree"), F.lit(level).alias("level"), "word", "n", "counts"))
        asked.append(met.where(small).select(F.col("node").alias("subtree"), "word", "counts", "surplus", "deficit"))
        if not sizes.where(~small).limit(1).count():
            break
        own = F.element_at("counts", level + 1)
        inside = staged(sized.where(~small).select("word", "n", "counts", F.concat_ws(",", "node", own.cast("string")).alias("node")), "trie-words")
        moves = met.where(~small).withColumn("move", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        moves = moves.where(((F.col("move") <= 0) | (F.col("surplus") > 0)) & ((F.col("move") >= 0) | (F.col("deficit") > 0)) & (own + F.col("move") >= 0))
        left = lambda budget, move: (F.col(budget) - (F.col("move") == move).cast("int")).alias(budget)
        name = F.concat_ws(",", "node", (own + F.col("move")).cast("string")).alias("node")
        searching = staged(moves.select("word", "counts", name, left("surplus", 1), left("deficit", -1)), "trie-searches")
    unite = lambda tables: tables[0] if len(tables) == 1 else unite([tables[0].unionByName(tables[1]), *tables[2:]])
    return unite(placed), unite(asked)


def reached(counts: np.ndarray, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Leaves that searches reach below ``level``: query, first and last row of the leaf. ``counts`` are sorted rows."""
    wide = int(max(counts.max(), queries.max())) + 3
    asking, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    changed = np.zeros(len(counts), bool)
    changed[0] = True
    parent = np.zeros(len(counts), np.int64)
    for at in range(level, counts.shape[1]):
        changed[1:] |= counts[1:, at] != counts[:-1, at]
        ways = parent[changed] * wide + counts[changed, at] + 1
        steps = []
        for move, allowed in ((-1, deficit > 0), (0, None), (1, surplus > 0)):
            who = np.arange(len(asking)) if allowed is None else np.flatnonzero(allowed)
            want = node[who] * wide + queries[asking[who], at] + move + 1
            to = np.searchsorted(ways, want)
            hit = ways[np.minimum(to, len(ways) - 1)] == want
            who = who[hit]
            steps.append((asking[who], to[hit], surplus[who] - (move > 0), deficit[who] - (move < 0)))
        asking, node, surplus, deficit = (np.concatenate(x) for x in zip(*steps, strict=True))
        parent = np.cumsum(changed) - 1
    starts = np.append(np.flatnonzero(changed), len(counts))
    return asking, starts[node], starts[node + 1]


class Letters:
    """Words as rows of letters, read from the left and from the right."""

    def __init__(self, words: list[bytes]):
        self.words = np.array(words, object)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        wide = MATRIX_WIDTH
        self.left = np.frombuffer(b"".join(w[:wide].ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        self.right = np.frombuffer(b"".join(w[: -wide - 1 : -1].ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns agree."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def one_edit(a: bytes, b: bytes) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    least, at = min(len(a), len(b)), 0
    while at < least and a[at] == b[at]:
        at += 1
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at + (len(a) > len(b)) :] == b[at + (len(b) > len(a)) :]


def verified(x: Letters, i: np.ndarray, y: Letters, j: np.ndarray) -> np.ndarray:
    """Whether the words differ by exactly one edit: what they share from both ends leaves one letter of the longer one."""
    least, most = np.minimum(x.lengths[i], y.lengths[j]), np.maximum(x.lengths[i], y.lengths[j])
    from_left = np.minimum(shared(x.left[i], y.left[j]), least)
    from_right = np.minimum(shared(x.right[i], y.right[j]), least)
    near = (from_left + from_right >= most - 1) & (most - least <= 1) & ~((most == least) & (from_left == most))
    for at in np.flatnonzero(most > MATRIX_WIDTH):
        near[at] = one_edit(x.words[i[at]], y.words[j[at]])
    return near


def search_subtree(words: list[bytes], n: np.ndarray, counts: np.ndarray, level: int, asked: list[bytes], queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
    """For each asked word: the number of near words among ``words``, and the place of the most frequent one, or -1."""
    order = np.lexsort(counts[:, ::-1].T)
    # Places by count, then code point: the least is the form.
    rank = np.empty(len(words), np.int64)
    by_rank = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)
    rank[by_rank] = np.arange(len(words))
    mine, theirs = Letters(words), Letters(asked)
    found, first = np.zeros(len(asked), np.int64), np.full(len(asked), len(words), np.int64)
    sorted_counts = counts[order]
    for begin in range(0, len(asked), BLOCK_QUERIES):
        block = slice(begin, begin + BLOCK_QUERIES)
        asking, start, end = reached(sorted_counts, queries[block], surplus[block], deficit[block], level)
        pairs = np.cumsum(end - start)
        cuts = [*np.searchsorted(pairs, np.arange(0, pairs[-1] if len(pairs) else 0, BLOCK_PAIRS), side="right"), len(asking)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = (end - start)[a:b]
            who = np.repeat(asking[a:b] + begin, size)
            at = order[np.repeat(start[a:b] - (np.cumsum(size) - size), size) + np.arange(len(who))]
            near = verified(theirs, who, mine, at)
            np.add.at(found, who[near], 1)
            np.minimum.at(first, who[near], rank[at[near]])
    return found, np.where(first < len(words), by_rank[np.minimum(first, len(words) - 1)], -1)


def near_words(words: DataFrame, groups: int = GROUPS, subtree_words: int = 20_000, part_queries: int = 50_000) -> DataFrame:
    """Rows (word, n_near, near, near_n) of the words that have a near word; ``near`` is the most frequent one."""
    counted = staged(with_counts(words, letter_groups(words, groups), groups), "word-counts")
    placed, asked = walk_top(counted, groups, subtree_words)
    asked = staged(asked, "searches")
    placed = staged(placed, "subtrees")
    chunks = placed.groupBy("subtree").agg(F.ceil(F.count("*") / subtree_words).cast("int").alias("chunks"))
    parts = asked.groupBy("subtree").agg(F.ceil(F.count("*") / part_queries).cast("int").alias("parts"))
    plan = staged(chunks.join(parts, "subtree"), "subtree-plan")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    left = placed.join(plan, "subtree").select("subtree", place("chunks").alias("chunk"), every("parts").alias("part"), "level", "word", "n", "counts")
    right = asked.join(plan, "subtree").select("subtree", every("chunks").alias("chunk"), place("parts").alias("part"), "word", "counts", "surplus", "deficit")
    schema = "word string, n_near long, near string, near_n long"

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        if not table.num_rows or not asked.num_rows:
            return empty
        rows = lambda t: t.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, groups).astype(np.int64)
        names = lambda t: [w.encode("latin-1") for w in t.column("word").to_pylist()]
        whole = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        n, level = whole(table, "n"), table.column("level")[0].as_py()
        found, best = search_subtree(names(table), n, rows(table), level, names(asked), rows(asked), whole(asked, "surplus"), whole(asked, "deficit"))
        some = np.flatnonzero(found)
        return pa.table(
            {
                "word": asked.column("word").take(pa.array(some)).combine_chunks(), "n_near": pa.array(found[some]),
                "near": table.column("word").take(pa.array(best[some])).combine_chunks(), "near_n": pa.array(n[best[some]]),
            }
        )

    key = ("subtree", "chunk", "part")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)
    most = F.max(F.col("near_n"))
    totals = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), most.alias("near_n"), F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("near"))
    return totals.select("word", "n_near", "near", "near_n")


def follow_forms(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form). Every round doubles the steps taken; a form is more frequent than its word, so there is an end."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = staged(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            return roots.select("word", "root")
        roots = roots.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``words`` (a stored table of word and n) with form, root, n_near and form_n.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent or more.
    """
    near = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    near = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "near-words")
    roots = follow_forms(near.where(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
