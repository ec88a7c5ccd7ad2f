"""Operator 7: packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, each a sequence by itself, and a rest
that is cut into pieces of at most `piece` ids. The pieces of about
`group_windows` windows form a group, and multiway differencing spreads them over
the group's windows: every piece starts as a partition of its own, and the two
partial partitions with the largest spread (largest less smallest window) are
merged again and again, the fullest windows of one with the emptiest of the
other. The windows come out nearly equal; if the fullest exceeds the capacity,
the window count rises by one and the group is partitioned anew.

Tokenising is one pass over the texts that keeps no ids: a piece's place, length
and checksum suffice for packing. Only those small rows are shuffled.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm._common import materialize, table

CAPACITY = 1024
PIECE = 256
GROUP_WINDOWS = 256
END_ID = 0
MEMO_UNITS, MEMO_PARTS, MEMO_CHARS = 400_000, 1_000_000, 64    # entries, and characters of one: about 0.25 GB in a Python worker
CHUNK_CHARS = 1 << 22       # of texts that are encoded together
LEARNED = 1 << 15           # units that the memos take at a time
# a byte-level model writes printable bytes of Latin-1 as themselves, the others as characters from 256 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}
# the pattern by which the byte-level tokenizer cuts a text before it merges (fixed value)
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# a cut before the middle blank would part a run of white space that belongs together
_INNER_BLANK = re.compile(r"\s (?:\s|\Z)")


class DocumentIds:
    """Texts -> little-endian unsigned 32-bit ids. Between two words that one blank
    separates the tokenizer always cuts, so the texts of a batch are cut before every
    blank and each distinct unit is encoded once; units met before are looked up, and
    so are the parts into which the tokenizer's own pattern cuts a new one. A new part
    goes straight to the tokenizer's model, which merges it. Texts with runs of white
    space, and those that hold the string of a token added to the vocabulary, are
    encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.units: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        letters = part.encode("utf-8").decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn(self, units: list[bytes]) -> dict[bytes, bytes]:
        cut_up = [PARTS.findall(u.decode("utf-8")) for u in units]
        new = {p for parts in cut_up for p in parts if p not in self.parts}
        ids = {p: self._part(p) for p in new}
        memo = self.parts
        found = {u: b"".join([ids[p] if p in ids else memo[p] for p in parts]) for u, parts in zip(units, cut_up)}
        # frequent ones come early: a memo that is full stays as it is
        for memo, most, more in ((self.parts, MEMO_PARTS, ids), (self.units, MEMO_UNITS, found)):
            memo.update(islice(((k, v) for k, v in more.items() if len(k) <= MEMO_CHARS), max(0, most - len(memo))))
        return found

    def _by_units(self, texts: list[bytes]) -> list[bytes]:
        bound = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        begins = np.append(data == 32, True)
        begins[bound] = True
        offset = np.flatnonzero(begins)
        units = pa.Array.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(joined)])
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new, found = [u for u in distinct if u not in self.units], {}
        for i in range(0, len(new), LEARNED):
            found.update(self._learn(new[i:i + LEARNED]))
        ids = [found[u] if u in found else self.units[u] for u in distinct]
        size = np.array([len(x) // 4 for x in ids], np.int32)
        first = np.cumsum(size, dtype=np.int32) - size
        at = coded.indices.to_numpy()
        size = size[at]
        end = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
        place = np.repeat(first[at] - end[:-1], size)
        place += np.arange(end[-1], dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")[place]
        edge = end[np.searchsorted(offset, bound)].tolist()
        return [flat[s:e].tobytes() for s, e in zip(edge, edge[1:])]

    def every(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; none for null."""
        start = 0
        while start < len(texts):
            out, regular, size, at = [], [], 0, start
            while at < len(texts) and size < CHUNK_CHARS:
                text = texts[at] or ""
                if _INNER_BLANK.search(text) or self.added and self.added.search(text):
                    out.append(self._whole(text))
                else:
                    out.append(None)
                    regular.append(text.encode("utf-8"))
                    size += len(text)
                at += 1
            rest = iter(self._by_units(regular))
            yield from (next(rest) if x is None else x for x in out)
            start = at


_encoders: dict[str, DocumentIds] = {}


def document_ids(path: str) -> DocumentIds:
    """One per Python worker: the tokenizer and what it has learned serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = DocumentIds(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the full windows and of the rest's pieces."""
    rest = n - n % capacity
    return ([(s, capacity) for s in range(0, rest, capacity)]
            + [(s, min(piece, n - s)) for s in range(rest, n, piece)])


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, row (the document's place in the
    table as it was read, for documents that share an identifier). A null text has the end id alone."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = document_ids(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.every(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for s, k in cut(n, capacity, piece):
                    at.append(i)
                    start.append(s)
                    length.append(k)
                    crc.append(crc32(ids[4 * s:4 * (s + k)]))
                    total.append(n)
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, at + row))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
            row += batch.num_rows

    return rows.mapInArrow(encode, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, row long")


def _difference(lengths: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing into m windows: the window of each piece, and the windows' sums."""
    n = len(lengths)
    if n == 0 or m == 1:
        return np.zeros(n, np.int64), np.array([lengths.sum()])
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)    # unions; the first n are the pieces
    made, heap = n, []
    for i, x in enumerate(lengths.tolist()):
        heap.append((-x, i, np.array([x]), np.array([i])))      # only the windows in use, ascending
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        if len(a) < len(b):
            a, ra, b, rb = b, rb, a, ra
        both = max(0, len(a) + len(b) - m)      # the other windows of one meet empty ones of the other
        sums = np.concatenate([a[:both] + b[::-1][len(b) - both:] if both == 0 else a[:both] + b[:both][::-1],
                               a[both:], b[both:]])
        roots = np.concatenate([np.arange(made, made + both), ra[both:], rb[both:]])
        left[made:made + both], right[made:made + both] = ra[:both], rb[:both][::-1]
        made += both
        order = np.argsort(sums, kind="stable")
        sums, roots = sums[order], roots[order]
        low = sums[0] if len(sums) == m else 0
        heapq.heappush(heap, (int(low - sums[-1]), turn, sums, roots))
        turn += 1
    _, _, sums, roots = heap[0]
    where = np.full(made, -1, np.int64)
    where[roots] = np.arange(len(roots))
    for node in range(made - 1, n - 1, -1):     # a union is made after its parts
        where[left[node]] = where[right[node]] = where[node]
    return where[:n], sums


def differencing(lengths, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, none over `capacity`; pieces are no longer than it."""
    lengths = np.asarray(lengths, dtype=np.int64)
    m = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        where, sums = _difference(lengths, m)
        if sums.max(initial=0) <= capacity:
            return where
        m += 1


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece; null and empty texts have the end id
    alone; rows that repeat an identifier, null ones too, are documents of their
    own, and however many they are, they spread over the groups. A very long text
    is tokenised in one piece in its task, and its windows spread too. Other columns
    are ignored; an empty table gives an empty result.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, id_col, text_col, capacity, piece))
    loose = pieces.agg(F.coalesce(F.sum(F.when(F.col("length") < capacity, F.col("length"))), F.lit(0)),
                       F.count(F.lit(1))).first()
    # a group holds group_windows windows of loose pieces, and about that many full ones or fewer pieces than 16 each
    groups = max(1, round(loose[0] / (capacity * group_windows)), loose[1] // (16 * group_windows))
    group = F.pmod(F.xxhash64("row", F.floor(F.col("start") / capacity)), F.lit(groups))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("start", "ascending")]).drop_columns(["group", "row"])
        length = rows["length"].to_numpy()
        full = length == capacity
        window = np.empty(len(length), np.int64)
        window[~full] = differencing(length[~full], capacity)
        window[full] = window[~full].max(initial=-1) + 1 + np.arange(full.sum())
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(np.diff(window[order], prepend=-1))
        offset = np.empty(len(length), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(length))))
        return (rows.append_column("sequence_id", pa.array((np.int64(key[0].as_py()) << 32) + window))
                .append_column("offset", pa.array(offset)))

    return (pieces.withColumn("group", group).groupBy("group")
            .applyInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                 "sequence_id long, offset long"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    return pack(docs, tokenizer_path())
