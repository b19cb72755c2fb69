"""Removal of repeated byte strings with suffix arrays, built by prefix-free parsing.

A byte goes if some string of ``length`` bytes (a window) that covers it also starts
anywhere else. Windows are compared exactly, but only where that can matter:

1. Marks. The representative of a window is the place in it with the least rolling hash
   (over 8 bytes). Consecutive windows with one representative form a mark. Equal windows
   have equal bytes around their representatives, so a mark's key is a hash of 200 of them
   that all its windows share. A mark whose key is unique holds no repeat.
2. Marks with equal keys and equal bytes are repeats as a whole. Where bytes differ but the
   key does not, one mark of each kind is sent, with its bytes, to the bucket of its key.
3. A bucket is parsed by rolling-hash triggers into phrases that overlap by a trigger, so
   no phrase is a prefix of another. The parts before a trigger are ranked in a dictionary
   of distinct phrases, sorted from their ends; the parts from a trigger on are ranked by
   the suffix array of the parse. Both ranks together put all windows of the bucket into
   one order in which equal ones are neighbours, and the least common prefix of neighbours
   tells them from others.
4. A key that more than ``hot_marks`` kinds of marks share (a very common passage) fits no
   bucket. The windows of its marks are counted by a 128-bit hash instead, and the most
   frequent of them are found by a broadcast join, not by a shuffle.

Texts are grouped by a 128-bit hash first, so a copied text is read and sent once.

Defined results: NULL and empty texts have no bytes and nothing to remove; a NULL id is
kept; repeated rows are copies of each other like any equal texts; texts of one character
repeated are all repeats; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

GRAM = 8
# One in 32 places is a trigger, on average.
TRIGGER_MASK = 31
# A mark's place and number of windows share a long.
COUNT_BITS = 20
BUCKET_BYTES = 4 << 20
#: Routes of a mark: a repeat as a whole; to its bucket; its windows one by one.
WHOLE, BUCKET, SINGLE = 0, 1, 2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 8 bytes from each place on."""
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)).view("<u8").ravel()
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def representatives(data: np.ndarray, length: int) -> np.ndarray:
    """For each window the place of its least hash, the first of equal ones."""
    hashes = gram_hashes(data)
    least = (hashes << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span, reach, windows = length - GRAM + 1, 1, len(data) - length + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:windows], least[span - reach : span - reach + windows])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def text_marks(text: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(key, hash of all bytes, first window, windows) of each mark; a mark ends where its shared bytes change sides."""
    from xxhash import xxh64_intdigest as digest

    if len(text) < length:
        return []
    at = representatives(np.frombuffer(text, np.uint8), length)
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(cuts[1:], len(at))
    half, found = length // 2, []
    for a, begin, end in zip(at[cuts].tolist(), cuts.tolist(), ends.tolist(), strict=True):
        turn = min(max(begin, a - half), end)
        if begin < turn:
            found.append((digest(text[a - half : a], 1), digest(text[begin : turn + length - 1], 3), begin, turn - begin))
        if turn < end:
            found.append((digest(text[a : a + half], 2), digest(text[turn : end + length - 1], 3), turn, end - turn))
    return found


def matched_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context which of its windows equals another one of any context here."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    counts = sizes - length + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = b"".join(contexts)
    data = np.frombuffer(whole + bytes(length), np.uint8)
    own = np.repeat(np.arange(len(contexts)), sizes)
    stop = starts + sizes
    # Triggers, each within one context.
    hashes = gram_hashes(data)[: len(whole)]
    trigger = np.flatnonzero((hashes & np.uint64(TRIGGER_MASK)) == 0)
    trigger = trigger[trigger + GRAM <= stop[own[trigger]]]
    window = np.concatenate([s + np.arange(n) for s, n in zip(starts, counts, strict=True)])
    matched = np.zeros(len(whole), bool)
    # The first trigger at or behind each window's start that lies within the window.
    following = np.searchsorted(trigger, window)
    known = np.append(trigger, len(whole) + length)
    before = known[following] - window
    parsed = before <= length - GRAM
    _match_unparsed(whole, window[~parsed], length, matched)
    window, following, before = window[parsed], following[parsed], before[parsed]
    if len(window):
        rank, common = _parse_order(whole, data, trigger, own, stop, length)
        head = _head_classes(whole, trigger, own, starts, following, before)
        order = np.lexsort((rank[following], head))
        h, r, need = head[order], rank[following][order], length - before[order]
        same = h[1:] == h[:-1]
        equal = same & (_least(common, r[:-1], r[1:]) >= need[1:])
        hit = np.zeros(len(order), bool)
        hit[1:] |= equal
        hit[:-1] |= equal
        matched[window[order[hit]]] = True
    return [matched[s : s + n] for s, n in zip(starts, counts, strict=True)]


def _parse_order(whole: bytes, data: np.ndarray, trigger: np.ndarray, own: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the text from each trigger to its context's end, and bytes in common with the rank below."""
    context, n = own[trigger], len(trigger)
    ends = np.append(trigger[1:], len(whole))
    last = np.append(context[1:] != context[:-1], True)
    ends = np.minimum(np.where(last, stop[context], ends + GRAM), stop[context])
    phrases = [whole[b:e] for b, e in zip(trigger.tolist(), ends.tolist(), strict=True)]
    number = {p: i + 1 for i, p in enumerate(sorted(set(phrases)))}
    rank = np.fromiter(map(number.__getitem__, phrases), np.int64, n)
    # Prefix doubling: a suffix of the parse ends with its context.
    left = np.zeros(n, np.int64)
    bounds = np.flatnonzero(last)
    left = bounds[np.searchsorted(bounds, np.arange(n))] - np.arange(n) + 1  # phrases up to the context's end
    reach = 1
    while reach < left.max():
        behind = np.zeros(n, np.int64)
        inside = left > reach
        behind[inside] = rank[np.flatnonzero(inside) + reach]
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        reach *= 2
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    first = np.zeros(rank.max() + 1, np.int64)
    first[rank[::-1]] = np.arange(n)[::-1]
    places, limits = trigger[first], (stop[context] - trigger)[first]
    common = np.zeros(len(first), np.int64)
    columns = np.arange(length)
    for at in range(1, len(first), 8192):
        upto = min(len(first), at + 8192)
        a, b = places[at - 1 : upto - 1], places[at:upto]
        differ = data[a[:, None] + columns] != data[b[:, None] + columns]
        shared = np.where(differ.any(1), differ.argmax(1), length)
        common[at:upto] = np.minimum(shared, np.minimum(limits[at - 1 : upto - 1], limits[at:upto]))
    return rank, common


def _head_classes(whole: bytes, trigger: np.ndarray, own: np.ndarray, starts: np.ndarray, following: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Equal numbers for windows with equal bytes before their first trigger, from the dictionary's phrases sorted from their ends."""
    context = own[trigger]
    begins = np.concatenate([[0], trigger[:-1]])
    first = np.concatenate([[True], context[1:] != context[:-1]])
    begins = np.where(first, starts[context], begins)
    heads = [whole[b:e][::-1] for b, e in zip(begins.tolist(), trigger.tolist(), strict=True)]
    ordered = sorted(set(heads))
    number = {p: i for i, p in enumerate(ordered)}
    phrase = np.fromiter(map(number.__getitem__, heads), np.int64, len(heads))[following]
    shared = np.zeros(len(ordered), np.int64)
    for i in range(1, len(ordered)):
        shared[i] = _common(ordered[i - 1], ordered[i])
    by_size = np.argsort(before, kind="stable")
    sizes, cuts = np.unique(before[by_size], return_index=True)
    classes = np.empty(len(before), np.int64)
    for size, begin, end in zip(sizes.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(by_size)], strict=True):
        some = by_size[begin:end]
        classes[some] = np.cumsum(shared < size)[phrase[some]] + size * (len(ordered) + 1)
    return classes


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _least(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``common`` over ranks above ``low`` up to ``high``; a large number where they are equal."""
    tables = [common]
    while 2 ** len(tables) < len(common):
        step = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    width = np.maximum(high - low, 0)
    out = np.full(len(low), np.iinfo(np.int64).max)
    for level, table in enumerate(tables):
        here = (width >= 2**level) & (width < 2 ** (level + 1))
        out[here] = np.minimum(table[low[here] + 1], table[high[here] - 2**level + 1])
    return out


def _match_unparsed(whole: bytes, windows: np.ndarray, length: int, matched: np.ndarray) -> None:
    """Windows without a trigger lie within one long phrase; they are compared by 128-bit hashes."""
    from xxhash import xxh3_128_digest as digest

    seen: dict[bytes, int] = {}
    for w in windows.tolist():
        other = seen.setdefault(digest(whole[w : w + length]), w)
        if other != w:
            matched[w] = matched[other] = True


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _marks(texts: DataFrame, length: int) -> DataFrame:
    """One row per distinct text: (k1, k2, copies, marks)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rows = [0], []
            for text in batch.column(2):
                rows += text_marks((text.as_py() or "").encode("utf-8", "surrogatepass"), length)
                counts.append(len(rows))
            hashes = np.array([(k, c) for k, c, _, _ in rows], np.uint64).reshape(-1, 2).view(np.int64)
            # A representative serves at most ``length`` windows, so their number fits beside the place.
            place = np.array([(lo << COUNT_BITS) | n for _, _, lo, n in rows], np.int64)
            parts = [pa.array(np.ascontiguousarray(x)) for x in (hashes[:, 0], hashes[:, 1], place)]
            marks = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(parts, ["key", "c", "at"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], ["k1", "k2", "marks"])

    found = texts.mapInArrow(work, "k1 long, k2 long, marks array<struct<key:long,c:long,at:long>>")
    # Copies merge before the shuffle: a group of copies is one row for each task that met it.
    return found.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("marks").alias("marks"))


def _routes(marks: DataFrame, hot_marks: int) -> DataFrame:
    """Rows (k1, k2, at, key, route) of the marks that may hold repeats.

    Keys with more than one in 10,000 of all marks, at most 10,000 keys therefore, go
    around the shuffle by key. A 64th of the marks finds them; both ways are exact.
    """
    total = marks.count()
    some = marks.where(F.pmod(F.xxhash64("k1", "at"), F.lit(64)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = staged(some.where(64 * F.col("n") > max(hot_marks, total // 10_000)).orderBy(F.desc("n")).limit(20_000).select("key"), "hot-keys")
    by_key, by_kind = Window.partitionBy("key"), Window.partitionBy("key", "c")
    cold = marks.join(F.broadcast(hot), "key", "left_anti").withColumn("marks", F.sum("copies").over(by_key)).where(F.col("marks") > 1)
    cold = cold.withColumn("same", F.sum("copies").over(by_kind)).withColumn("nth", F.row_number().over(by_kind.orderBy("k1", "k2", "at")))
    cold = cold.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(by_key))
    whole = F.when(F.col("same") > 1, F.lit(WHOLE))
    sent = F.when((F.col("kinds") > 1) & (F.col("nth") == 1), F.when(F.col("kinds") > hot_marks, F.lit(SINGLE)).otherwise(F.lit(BUCKET)))
    routed = cold.select("k1", "k2", "at", "key", F.explode(F.array(whole, sent)).alias("route")).where(F.col("route").isNotNull())
    singles = marks.join(F.broadcast(hot), "key", "left_semi").select("k1", "k2", "at", "key", F.lit(SINGLE).alias("route"))
    return routed.unionByName(singles)


def _bucket_runs(carriers: DataFrame, length: int, buckets: int) -> DataFrame:
    """Runs of matched windows (k1, k2, begin, end) within the marks sent to buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, begins, parts = [], [], [], []
            for i, (text, marks) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for mark in marks.as_py():
                    if mark["route"] == BUCKET:
                        lo, n = mark["at"] >> COUNT_BITS, mark["at"] & ((1 << COUNT_BITS) - 1)
                        at.append(i)
                        keys.append(mark["key"])
                        begins.append(lo)
                        parts.append(data[lo : lo + n + length - 1])
            index = pa.array(at, pa.int64())
            bucket = np.array(keys, np.int64) % buckets
            columns = [pa.array(bucket, pa.int64()), batch.column(0).take(index), batch.column(1).take(index), pa.array(begins, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "k1", "k2", "begin", "part"])

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = matched_windows(table.column("part").to_pylist(), length)
        at, begins, ends = [], [], []
        for i, flags in enumerate(found):
            b, e = runs(flags)
            at += [i] * len(b)
            begins.append(b)
            ends.append(e)
        index = pa.array(at, pa.int64())
        shift = table.column("begin").to_numpy()[np.array(at, np.int64)]
        begin, end = (np.concatenate(x) + shift if x else np.empty(0, np.int64) for x in (begins, ends))
        return pa.table({"k1": table.column("k1").take(index), "k2": table.column("k2").take(index), "begin": begin.astype(np.int64), "end": end.astype(np.int64)})

    sent = carriers.where(F.exists("marks", lambda m: m["route"] == BUCKET)).select("k1", "k2", "text", "marks")
    return (
        sent.mapInArrow(send, "bucket long, k1 long, k2 long, begin long, part binary")
        .groupBy("bucket")
        .applyInArrow(match, "k1 long, k2 long, begin long, end long")
    )


def _single_runs(carriers: DataFrame, length: int, hot_places: int) -> DataFrame:
    """Runs of one window (k1, k2, begin, end) within the marks of hot keys.

    Windows with more than ``hot_places`` places and one in 10,000 of all, at most 10,000
    windows therefore, go around the shuffle by window.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest as digest

        for batch in batches:
            at, places, w1, w2 = [], [], [], []
            for i, (text, marks) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for mark in marks.as_py():
                    if mark["route"] == SINGLE:
                        lo, n = mark["at"] >> COUNT_BITS, mark["at"] & ((1 << COUNT_BITS) - 1)
                        for place in range(lo, lo + n):
                            h = digest(data[place : place + length])
                            at.append(i)
                            places.append(place)
                            w1.append(h >> 64)
                            w2.append(h & 0xFFFFFFFFFFFFFFFF)
            index = pa.array(at, pa.int64())
            hashes = [pa.array(np.array(w, np.uint64).view(np.int64)) for w in (w1, w2)]
            columns = [*hashes, batch.column(0).take(index), batch.column(1).take(index), pa.array(places, pa.int64()), batch.column(4).take(index)]
            yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "k1", "k2", "begin", "copies"])

    sent = carriers.where(F.exists("marks", lambda m: m["route"] == SINGLE)).select("k1", "k2", "text", "marks", "copies")
    windows = staged(sent.mapInArrow(split, "w1 long, w2 long, k1 long, k2 long, begin long, copies long"), "hot-windows")
    window = ["w1", "w2"]
    often = staged(windows.groupBy(window).agg(F.sum("copies").alias("n"), F.count("*").alias("places")).where(F.col("n") > 1), "often")
    most = F.broadcast(often.where(F.col("places") > max(hot_places, windows.count() // 10_000)).select(window))
    others = windows.join(most, window, "left_anti").join(often.select(window), window, "left_semi")
    found = windows.join(most, window, "left_semi").unionByName(others)
    return found.select("k1", "k2", "begin", (F.col("begin") + 1).alias("end"))


def _cut(carriers: DataFrame, length: int) -> DataFrame:
    """Rows (k1, k2, n_removed, n_spans, kept_sha256, spans, kept) of the texts that lose something."""
    schema = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, counts, digests, spans, texts = [], [], [], [], []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                data, own = text.as_py().encode("utf-8", "surrogatepass"), []
                for r in sorted((r["begin"], r["end"] + length - 1) for r in found.as_py()):
                    if own and r[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], r[1])
                    else:
                        own.append(list(r))
                ends = [0, *(x for span in own for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                texts.append(kept.decode("utf-8", "replace"))
                removed.append(sum(e - b for b, e in own))
                counts.append(len(own))
                digests.append(hashlib.sha256(kept).hexdigest())
                spans.append([{"begin": b, "end": e} for b, e in own])
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return carriers.mapInArrow(work, schema)


def repeated_bytes(docs: DataFrame, length: int = 400, hot_marks: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end) of removed bytes, and text, what is left.

    Bytes are removed, so a character may lose some of its own; in ``text`` the rest of it is U+FFFD.
    """
    text = F.col(text_column)
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    long = keyed.where(F.octet_length("text") >= length)
    by_text = staged(_marks(long.select("k1", "k2", "text"), length), "marks")
    marks = by_text.select("k1", "k2", "copies", F.explode("marks").alias("m")).select("k1", "k2", "copies", "m.*")
    routes = staged(_routes(marks, hot_marks), "routes")
    n = F.col("at").bitwiseAND((1 << COUNT_BITS) - 1)
    weight = routes.where(F.col("route") == BUCKET).agg(F.sum(n + length)).first()[0] or 0
    routed = routes.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "key", "route")).alias("marks"))
    texts = long.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    carriers = staged(texts.join(routed, ["k1", "k2"]), "carriers")
    whole = carriers.select("k1", "k2", F.explode(F.filter("marks", lambda m: m["route"] == WHOLE)).alias("m"))
    lo, count = F.shiftright("m.at", COUNT_BITS), F.col("m.at").bitwiseAND((1 << COUNT_BITS) - 1)
    found = whole.select("k1", "k2", lo.alias("begin"), (lo + count).alias("end"))
    # All windows of a copied text are repeats, also those of hot keys.
    found = found.unionByName(_bucket_runs(carriers, length, max(1, -(-weight // BUCKET_BYTES)))).unionByName(_single_runs(carriers, length, hot_marks))
    per_text = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    cut = _cut(carriers.select("k1", "k2", "text").join(per_text, ["k1", "k2"]), length)
    zero = F.lit(0).cast("bigint")
    return keyed.join(cut, ["k1", "k2"], "left").select(
        "id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>")).alias("spans"),
        F.coalesce("kept", "text").alias("text"),
    )
