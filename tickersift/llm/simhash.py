"""SimHash near duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within half the radius of each.
Every distinct fingerprint emits all its variants within that half radius, variants meet
in a shuffle, and fingerprints with a common variant are linked. All that share one are
within ``radius`` of each other, so a chain through the smallest links them without
listing pairs; links are deduplicated and verified before they are written.

A variant is emitted in two steps, so that 2081 variants cost no 2081 rows: its first
``bits`` bits choose a bucket, and a fingerprint is sent once to each bucket that some
variant reaches (56 for 10 bits). The variants of the remaining bits are made there, in
memory, a bounded number at a time.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked like
any other; exact copies share a fingerprint, so a group of any size is one node; a NULL
id is never a component's smallest id; repeated rows give repeated results; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.llm.components import connected_components

BITS = 64
# Variants of one step in a task, 16 bytes each.
STEP_VARIANTS = 1 << 21


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only


def text_fingerprint(text: str | None, words: int) -> int:
    """The majority of the XXH64 bits of all shingles; long texts go through in slices."""
    import xxhash

    split = text_words(text)
    if not split:
        return 0
    joined = b" ".join(split)
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.cumsum(lengths + 1) - lengths - 1
    span = min(words, len(split))
    begins, ends = starts[: len(split) - span + 1], (starts + lengths)[span - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(begins), 1 << 16):
        b, e = begins[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist()
        h = np.fromiter([digest(joined[i:j], 42) for i, j in zip(b, e, strict=True)], "<u8", len(b))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp): fp is the fingerprint's 64 bits as a long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([text_fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(compute, f"id {id_type}, fp long")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def flips(bits: int, most: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)]


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints (distinct longs in fp) within ``radius`` bits."""
    half = (radius + 1) // 2
    variants = sum(math.comb(BITS, k) for k in range(half + 1))
    count = fps.count()
    bits = max(10, math.ceil(math.log2(max(1, count * variants) / (2 * STEP_VARIANTS) + 1)))
    suffix = BITS - bits
    masks = [m << suffix for m in flips(bits, half)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    variant = F.explode(F.array(*[F.lit(m).cast("bigint") for m in signed]))
    sent = fps.select("fp", variant.alias("mask")).select(
        F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("mask")), suffix).alias("bucket"), "fp"
    )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        prefix = np.uint64(key[0].as_py())
        used = np.bitwise_count((fp >> np.uint64(suffix)) ^ prefix).astype(np.int64)
        a, b = linked(fp, half - used, prefix << np.uint64(suffix), bits, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def linked(fp: np.ndarray, left: np.ndarray, prefix: np.uint64, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that have variants with this ``prefix`` of ``bits`` bits.

    ``left`` is the number of bits that each may still flip behind the prefix. While there
    are too many variants to hold, the two longer prefixes are taken one after the other.
    """
    none = np.empty(0, np.uint64)
    if len(fp) < 2:
        return none, none
    rest = BITS - bits
    ball = np.array([sum(math.comb(rest, k) for k in range(n + 1)) for n in range(int(left.max()) + 1)])
    if ball[left].sum() > STEP_VARIANTS and rest > 16:
        found = []
        for bit in (0, 1):
            longer = prefix | (np.uint64(bit) << np.uint64(rest - 1))
            still = left - (((fp >> np.uint64(rest - 1)) & np.uint64(1)) != bit)
            found.append(linked(fp[still >= 0], still[still >= 0], longer, bits + 1, radius))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    low = np.uint64((1 << rest) - 1)
    made, source, spent = [], [], []
    for n in range(int(left.max()) + 1):
        own = np.flatnonzero(left == n)
        masks = np.array(flips(rest, n), np.uint64)
        made.append(((fp[own] & low)[:, None] ^ masks).ravel())
        source.append(np.repeat(own, len(masks)))
        if radius % 2:
            spent.append(np.tile(np.bitwise_count(masks) == n, len(own)))
    variant, source = np.concatenate(made), np.concatenate(source)
    if radius % 2:
        # Two that flipped the most bits each may be too far apart by one. One that flipped fewer is near all the
        # others; it comes first. Without such a one, pairs near enough meet at another variant.
        order = np.lexsort((np.concatenate(spent), variant))
    else:
        order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], fp[source[order]]
    same = variant[1:] == variant[:-1]
    if not same.any():
        return none, none
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    chosen = owner[begins] if radius % 2 else np.minimum.reduceat(owner, begins)
    least = np.repeat(chosen, np.diff(np.append(begins, len(owner))))
    apart = least != owner
    pairs = np.unique(np.stack([least[apart], owner[apart]], 1), axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
    return forest(pairs)


def forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: at most one per fingerprint."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    a, b = [], []
    for x, y in pairs.tolist():
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            a.append(x)
            b.append(y)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (hexadecimal) and component_id, the smallest id reachable over links."""
    marked = staged(fingerprints(docs, words, id_column, text_column), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    components = staged(connected_components(near_links(distinct.select("fp"), radius)), "components")
    of_fp = distinct.join(components, distinct["fp"] == components["node"], "left")
    of_fp = of_fp.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = of_fp.join(smallest, "component").select(F.col("fp").alias("label_fp"), "component_id")
    joined = marked.join(labels, marked["fp"] == labels["label_fp"])
    return joined.select("id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


# Verified near duplicates. Fingerprints within ``radius`` bits that are cut into
# ``radius + 3`` blocks agree on three blocks at least. Two of them choose the bucket that
# a text is sent to, the third one splits large buckets.
AGREEING = 3
# Rows that a task holds at once, on average; their buckets lie together.
PART_ROWS = 1 << 18
# Texts of a bucket that are compared with each other at once.
DIRECT = 2048


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of a fingerprint."""
    ends = [BITS * i // (radius + AGREEING) for i in range(radius + AGREEING + 1)]
    return [(b, e - b) for b, e in zip(ends, ends[1:], strict=False)]


def close_pairs(fp: np.ndarray, component: np.ndarray, later: list[tuple[int, int]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all texts within ``radius`` bits that are in different components and agree on one of the ``later`` blocks."""
    if len(fp) > DIRECT and later:
        for shift, width in later:
            value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(value, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                for i, j in close_pairs(fp[own], component[own], [], radius):
                    yield own[i], own[j]
        return
    step = max(1, STEP_VARIANTS // max(1, len(fp)))
    for at in range(0, len(fp), step):
        near = np.bitwise_count(fp[at : at + step, None] ^ fp[at:]) <= radius
        i, j = np.nonzero(near & (component[at : at + step, None] != component[at:]))
        yield i[i < j] + at, j[i < j] + at


def candidate_pairs(nodes: DataFrame, radius: int, every: bool) -> DataFrame:
    """Pairs (a, b) of nodes within ``radius`` bits; ``nodes`` has node, fp and component.

    With ``every``, all pairs of different components. Else only two for each text of a
    bucket, the least and the next smaller fingerprint, which is enough to join most
    copies of a text without listing all their pairs.
    """
    cut = blocks(radius)
    pairs = list(itertools.combinations(range(len(cut) - 1), AGREEING - 1))

    def value(i: int) -> Column:
        shift, width = cut[i]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    widest = max(width for _, width in cut)
    keys = [F.lit(n << (2 * widest)).cast("bigint") + F.shiftleft(value(i), widest) + value(j) for n, (i, j) in enumerate(pairs)]
    parts = max(64, math.ceil(nodes.count() * len(pairs) / PART_ROWS))
    sent = nodes.select(F.explode(F.array(*keys)).alias("bucket"), "node", "fp", "component")

    def meet(table: pa.Table) -> pa.Table:
        bucket, node, component, fp = (table.column(c).to_numpy() for c in ("bucket", "node", "component", "fp"))
        order = np.lexsort((node, fp, bucket))
        bucket, node, component, fp = bucket[order], node[order], component[order], fp[order].view(np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(begins, len(fp)))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if every:
            for at, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if (component[at : at + n] != component[at]).any():
                    later = cut[pairs[int(bucket[at]) >> (2 * widest)][1] + 1 :]
                    found += [(i + at, j + at) for i, j in close_pairs(fp[at : at + n], component[at : at + n], later, radius)]
        else:
            least = np.repeat(begins, sizes)
            own = np.flatnonzero(np.arange(len(fp)) != least)
            for other in (own - 1, least[own]):
                near = np.bitwise_count(fp[own] ^ fp[other]) <= radius
                found.append((own[near], other[near]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    part = F.pmod(F.xxhash64("bucket"), F.lit(parts))
    return sent.groupBy(part.alias("part")).applyInArrow(meet, "a long, b long").distinct()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles as sorted XXH64 values: a very long text takes eight bytes a shingle, not an object each."""
    import xxhash

    split = text_words(text)
    span = max(1, min(words, len(split)))
    shingles = (b" ".join(split[i : i + span]) for i in range(len(split) - span + 1))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of shingles have a Jaccard similarity of at least ``similarity``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingle_hashes(x.as_py(), words), shingle_hashes(y.as_py(), words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def verified_near_duplicates(
    docs: DataFrame, words: int = 5, radius: int = 10, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, component_id): components over pairs within ``radius`` bits whose shingles were compared.

    A node is a text without regard to ASCII case and white space. Copies are joined over
    few verified pairs first; then all pairs of nodes that are still apart are verified.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = np.empty((2, batch.num_rows), np.uint64)
            for row, value in enumerate(batch.column(1)):  # one text at a time, so that no batch is held twice
                text = value.as_py()
                found[:, row] = xxhash.xxh64_intdigest(b" ".join(text_words(text)), 7), text_fingerprint(text, words)
            node, fp = (pa.array(x.view(np.int64), pa.int64()) for x in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), node, fp], ["id", "node", "fp"])

    id_type = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = staged(narrow.mapInArrow(compute, f"id {id_type}, node long, fp long"), "marked")
    nodes = staged(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.min("id").alias("least")), "nodes")
    owners = nodes.select("node", F.col("least").alias("id"))
    texts = narrow.join(owners, narrow["id"].eqNullSafe(owners["id"])).select("node", "text")

    def labelled(links: DataFrame) -> DataFrame:
        found = connected_components(links).select("node", "component")
        return staged(nodes.join(found, "node", "left").select("node", "fp", "least", F.coalesce("component", "node").alias("component")), "labelled")

    first = staged(candidate_pairs(nodes.withColumn("component", F.col("node")), radius, False), "first-pairs")
    links = staged(verified(first, texts, words, similarity), "first-links")
    rest = staged(candidate_pairs(labelled(links), radius, True).join(first, ["a", "b"], "left_anti"), "other-pairs")
    labels = labelled(links.unionByName(staged(verified(rest, texts, words, similarity), "other-links")))
    smallest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = labels.join(smallest, "component").select("node", "component_id")
    return marked.join(of_node, "node").select("id", "component_id")
