"""Best-fit decreasing packing of tokenised documents into sequences.

Documents are tokenised in the tasks that read them; only document ids, lengths and
checksums are shuffled. Pieces are dealt over groups of about ``group_pieces`` and each
group is packed alone: longest piece first, into the open sequence that it fills best.
A group wastes at most its last few sequences, so the number of groups, which grows
with the input, costs less than one sequence in a thousand.

Defined results: a NULL text is an empty document, which is the end token alone;
repeated rows are packed one by one; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersift.functions.scratch import staged

END_TOKEN = 1
# Most documents consist of words met before. Their ids are kept, up to this many words per worker.
KNOWN_WORDS = 500_000
KNOWN_LENGTH = 48
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds(dict):
    """Ids of whole texts, word by word; words between ASCII white space are tokenised independently.

    ``encode`` gives the ids as little-endian unsigned 32-bit numbers. A word of letters
    with punctuation behind it is two words for the tokeniser; both parts are looked up.
    As a mapping it is the ids of words met before, and makes those of a new one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)

    def _fresh(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self) < KNOWN_WORDS and len(word) <= KNOWN_LENGTH:
            self[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(PUNCTUATION)
        if len(body) < len(word) and body.lower().isalpha():  # letters in lower case too, as one with a dot above is not
            return self._keep(word, self._part(body) + self._part(word[len(body) :]))
        return self._keep(word, self._part(word))

    def _part(self, part: str) -> bytes:
        key = part.lower() if part.isascii() and part.isalpha() else part
        ids = self.get(key)
        return self._keep(key, self._fresh(key)) if ids is None else ids

    def encode(self, text: str) -> bytes:
        if text.isascii() and "<|" not in text:  # a special token's case counts
            text = text.lower()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


def token_pieces(
    docs: DataFrame, tokenizer: str, max_tokens: int = 4096, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), and with ``with_ids`` the ids as an array."""
    id_type = docs.schema[id_column].dataType
    fields = [
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = np.asarray([END_TOKEN], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = batch.column(1)
            for row in range(batch.num_rows):
                buffer = memoryview(encoder.encode(texts[row].as_py() or "") + end)
                for n, begin in enumerate(range(0, len(buffer), 4 * max_tokens)):
                    part = buffer[begin : begin + 4 * max_tokens]
                    at.append(row)
                    piece.append(n)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, T.StructType(fields))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece.

    The leaves of the segment tree are the remaining capacities; a node says whether an
    open sequence with a capacity below it exists. The tightest one that fits is the next
    marked leaf at or after the piece's length: up the tree, then down, in logarithmic time.
    """
    width = 1 << int(capacity).bit_length()
    tree = bytearray(2 * width)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = _tightest(tree, width, need)
        if found is None:
            room, number = capacity, count
            count += 1
        else:
            room = found
            number = open_at[room].pop()
            if not open_at[room]:
                _mark(tree, width + room, 0)
        bins[i], offsets[i] = number, capacity - room
        room -= need
        if room:
            if not open_at[room]:
                _mark(tree, width + room, 1)
            open_at[room].append(number)
    return bins, offsets


def _tightest(tree: bytearray, width: int, need: int) -> int | None:
    """The smallest marked capacity that is at least ``need``."""
    node = width + need
    if tree[node]:
        return need
    while node > 1:
        if not node & 1 and tree[node + 1]:
            node += 1
            while node < width:
                node = 2 * node if tree[2 * node] else 2 * node + 1
            return node - width
        node >>= 1
    return None


def _mark(tree: bytearray, node: int, value: int) -> None:
    tree[node] = value
    while node > 1:
        node >>= 1
        value = tree[2 * node] | tree[2 * node + 1]
        if tree[node] == value:
            return
        tree[node] = value


def pack(pieces: DataFrame, max_tokens: int = 4096, group_pieces: int = 100_000) -> DataFrame:
    """``pieces`` (with a column length) plus sequence_id and offset; other columns are kept.

    ``pieces`` is a stored table. Groups are dealt by a hash of the row's place, so no
    repeated row can crowd one group.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("_group")
    names = pieces.columns

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), max_tokens)
        ids = (int(key[0].as_py()) << 36) + bins
        return table.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.select(*names, group).groupBy("_group").applyInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, group_pieces: int = 100_000) -> DataFrame:
    """Tokenise, cut and pack whole documents. The pieces are written once, so a lost executor costs no tokenising."""
    return pack(staged(token_pieces(docs, tokenizer, max_tokens), "pack-pieces"), max_tokens, group_pieces)
