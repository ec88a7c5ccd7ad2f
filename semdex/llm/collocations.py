"""Operator 12: phrase collocation mining with Rabin-Karp fingerprints.

The texts of an Arrow batch are one run of bytes. Prefix polynomials over the bytes
give every word a hash, prefix polynomials over the words' hashes give every n-gram
a fingerprint, each by one subtraction and one product, for all places at once.

A phrase can be frequent only if its parts are, so three passes find what may be
frequent: words; pairs of such words; longer phrases all of whose pairs are such. A
pass counts slots (the fingerprints' low bits) in sorted, delta-coded blocks. What it
finds is known to the next one by a bitmap of at most `bitmap_bits` bits, a broadcast
of fixed size; clashes of slots or bits cost a row later and can't change a result.

The last pass counts the n-grams that may be frequent: a task emits (fingerprint,
check, count, pointer to one occurrence) and the shuffle sums them; the check is a
second fingerprint from other polynomials, which tells clashing ones apart. Within a
task the n-grams of a fingerprint are held against each other word by word, and only
frequent ones are followed to their text: the phrase is read where the pointer leads,
and both fingerprints are computed from it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdex.llm._common import delta_planes, from_delta_planes, materialize, partitions, table

MIN_COUNT, MAX_WORDS, PERCENT, TOP = 100, 5, 100, 2000      # the query's contract
COUNT_WORDS, FLUSH_GRAMS = 1 << 22, 1 << 19                 # words and n-grams of a task that are counted at a time
SEGMENT_BYTES = 1 << 20
BITMAP_BITS = 27
SLOT_BITS = 44
FINGERPRINT_BITS = 64
BUCKET_WORDS = 1 << 21      # words of the corpus for each bucket of the shuffle
HELD_ROWS = 3 << 19         # counted n-grams that a task combines before it emits them
BROADCAST_ROWS = 1 << 20

PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
                                  for b in (self.base, self.inverse))
        return self.up, self.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Polynomials:
    """A family of fingerprints: values of the bytes, and odd bases (which have inverses modulo 2**64)."""

    def __init__(self, seed: int, byte_base: int, word_base: int):
        self.value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bytes, self.words = _Powers(byte_base), _Powers(word_base)

    def prefix(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums over the words' hashes, and the inverse powers that bring a difference back to place 0."""
        up, down = self.bytes(len(low) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[low] * up[:len(low)])])
        words = _mix((prefix[end] - prefix[start]) * down[start])
        up, down = self.words(len(words) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)])]), down


FAMILIES = (_Polynomials(20240611, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95), _Polynomials(20250117, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Segment:
    """Words of a run of bytes, and fingerprints of its n-grams."""

    def __init__(self, data: np.ndarray, bits: int = FINGERPRINT_BITS):
        kind = _KIND[data]
        self.blank = kind > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.blank, [True]]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        piece = np.cumsum(kind == 2)
        self.piece = piece[self.start] if len(self.start) else self.start
        self.low, self.shift = _LOWER[data], np.uint64(64 - bits)
        self.prefix = {}

    def __len__(self) -> int:
        return len(self.start)

    def fingerprints(self, at: np.ndarray, size: int, language: np.ndarray, family: int = 0) -> np.ndarray:
        """Of the n-grams of `size` words that begin with the words `at`; `language`: a hash for each."""
        if family not in self.prefix:
            self.prefix[family] = FAMILIES[family].prefix(self.low, self.start, self.end)
        prefix, down = self.prefix[family]
        gram = _mix((prefix[at + size] - prefix[at]) * down[at] + _mix(language * np.uint64(8) + np.uint64(size)))
        return gram >> self.shift if family == 0 else gram

    def inside(self, size: int) -> np.ndarray:
        """Words at which an n-gram of `size` words within one piece begins."""
        if len(self) < size:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[size - 1:] == self.piece[:len(self) - size + 1])

    def numbers(self, known: dict[bytes, int]) -> np.ndarray:
        """A number for each word, the same for equal bytes; new ones enter `known`."""
        letters = np.ascontiguousarray(self.low[~self.blank])
        offset = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offset), pa.py_buffer(letters)])
        found = words.dictionary_encode()
        number = np.array([known.setdefault(w, len(known)) for w in found.dictionary.to_pylist()], np.int32)
        return number[found.indices.to_numpy()] if len(number) else np.empty(0, np.int32)

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[at:at + size], self.end[at:at + size])).decode("utf-8", "replace")


def cuts(data: np.ndarray, segment_bytes: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about `segment_bytes`, each but the last ended by the end of a piece,
    so that no n-gram is parted; a longer piece stays whole."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + segment_bytes)
        step = 4096
        while end < n:
            ends = np.flatnonzero(_KIND[data[end - 1:end - 1 + step]] == 2)
            if len(ends):
                end += int(ends[0])
                break
            end, step = min(n, end + step), step * 2
        yield start, end
        start = end


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offset of each, the end last."""
    wide = pa.types.is_large_string(texts.type)
    offset = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offset[0]:offset[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offset - offset[0]


class Bitmap:
    """Which fingerprints may be frequent, by their low bits; packed."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.mask, self.packed = np.uint64((1 << bits) - 1), packed

    def __getitem__(self, fingerprints: np.ndarray) -> np.ndarray:
        slot = fingerprints & self.mask
        return (self.packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _grams(segment: Segment, language: np.ndarray, sizes, maps: dict[int, Bitmap]):
    """(size, places, fingerprints) of the n-grams that may be frequent: single words, if `maps` does
    not know them; longer ones all of whose parts are in `maps` (of words for pairs, else of pairs);
    of those, where `maps` knows their own size, the ones in it."""
    may = {}
    for part in {min(s - 1, 2) for s in sizes} - {0}:
        at = segment.inside(part)
        may[part] = np.zeros(len(segment) + max(sizes), bool)
        may[part][at] = maps[part][segment.fingerprints(at, part, language[at])]
    for size in sizes:
        part, at = min(size - 1, 2), segment.inside(size)
        if part:
            keep = np.ones(len(at), bool)
            for j in range(size - part + 1):
                keep &= may[part][at + j]
            at = at[keep]
        fingerprint = segment.fingerprints(at, size, language[at])
        own = maps.get(min(size, 3))
        if own is not None:
            keep = own[fingerprint]
            at, fingerprint = at[keep], fingerprint[keep]
        yield size, at, fingerprint


def _segments(batches: Iterator[pa.RecordBatch], bits: int, segment_bytes: int):
    """(segment, keys and languages of the texts, first text, text of each word, its offset there)."""
    for batch in batches:
        data, bound = _text_bytes(batch.column("text"))
        keys, languages = (batch.column(c).to_numpy() for c in ("key", "language"))
        for start, end in cuts(data, segment_bytes):
            segment = Segment(data[start:end], bits)
            if len(segment):
                text = np.searchsorted(bound, segment.start + start, side="right") - 1
                low, high = int(text[0]), int(text[-1]) + 1
                yield segment, keys[low:high], languages[low:high].view(np.uint64), text - low, segment.start + start - bound[text]


def _ranges(sorted_values: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted values that agree above `shift` bits."""
    bucket = sorted_values >> np.uint64(shift)
    first = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
    return [(int(bucket[s]), int(s), int(e)) for s, e in zip(first, np.append(first[1:], len(bucket)))]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows of one bucket after the other, of batches sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *names))):
            if b != bucket:
                if rows:
                    yield rows
                bucket, rows = b, []
            rows.append(row)
    if rows:
        yield rows


def _count_slots(sizes, shared, bits: int, bucket_bits: int, most: int, count_words: int, segment_bytes: int):
    """(key, language, text) -> (bucket, slots, n): sorted slots and how often each occurs, `most` at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            slots = np.sort(np.concatenate(held))
            if len(slots):
                first = np.flatnonzero(np.diff(slots, prepend=~slots[:1]))
                slots, n = slots[first], np.minimum(np.diff(np.append(first, len(slots))), most)
                parts = _ranges(slots, SLOT_BITS - bucket_bits)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in parts], pa.int64()), pa.array([delta_planes(slots[s:e], 6) for _, s, e in parts], pa.binary()),
                    pa.array([_planes(n[s:e], 4) for _, s, e in parts], pa.binary())], names=["bucket", "slots", "n"])

        maps = shared.value
        for segment, _, languages, text, _ in _segments(batches, bits, segment_bytes):
            for _, _, fingerprint in _grams(segment, languages[text], sizes, maps):
                held.append(fingerprint & np.uint64((1 << SLOT_BITS) - 1))
            words += len(segment)
            if words >= count_words:
                yield from flush()
                held, words = [], 0
        if held:
            yield from flush()

    return count


def _planes(n: np.ndarray, width: int) -> bytes:
    return n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def _frequent_slots(min_count: int):
    """Sorted (bucket, slots, n) -> slots that occur `min_count` times or more."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["slots", "n"]):
            slots, n = (np.concatenate(x) for x in zip(*((from_delta_planes(s, 6), _from_planes(n, 4)) for s, n in rows)))
            order = np.argsort(slots, kind="stable")
            first = np.flatnonzero(np.diff(slots[order], prepend=~slots[order[:1]]))
            keep = np.add.reduceat(n[order], first) >= min_count
            yield pa.RecordBatch.from_arrays([pa.array(slots[order[first[keep]]].view(np.int64))], names=["slot"])

    return merge


def _bitmap(found: DataFrame, most_bits: int) -> Bitmap:
    """Of the slots in `found`: 64 bits for each, 2**most_bits at most. Built in pieces of 8 KB in as
    many tasks as there are partitions; the driver joins the pieces."""
    bits = min(most_bits, max(16, (max(found.count(), 1) * 64).bit_length()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            slots = slots[np.argsort(slots >> 16, kind="stable")]
            for piece, s, e in _ranges(slots.view(np.uint64), 16):
                packed = held.setdefault(piece, np.zeros(8192, np.uint8))
                np.bitwise_or.at(packed, (slots[s:e] & 0xFFFF) >> 3, (1 << (slots[s:e] & 7)).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                             names=["piece", "bits"])

    rows = (found.select(F.col("slot").bitwiseAND((1 << bits) - 1).alias("slot")).withColumn("piece", F.shiftright("slot", 16))
            .repartition(partitions(found.sparkSession), "piece").mapInArrow(pieces, "piece long, bits binary").collect())
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        packed[r["piece"] << 13:(r["piece"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(bits, packed)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first one does."""
    return np.concatenate([np.ones(len(values[:1]), bool), values[1:] != values[:-1]])


class _Counter:
    """The n-grams of one part of a task that may be frequent, and how many words each language has."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.words = self.texts = self.grams = 0
        self.per_word, self.per_text, self.per_gram = [], [], []
        self.languages: dict[int, tuple[int, int, int]] = {}    # words, and the smallest (key, offset) of one

    def add(self, segment: Segment, keys, languages, text, offset, grams) -> None:
        self.per_word.append((segment.numbers(self.known), (text + self.texts).astype(np.int32), offset))
        self.per_text.append((keys, languages))
        for size, at, fingerprint in grams:
            check = segment.fingerprints(at, size, languages[text[at]], 1)
            self.per_gram.append((fingerprint, check, (at + self.words).astype(np.int32), np.full(len(at), size, np.int8)))
            self.grams += len(at)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        n = np.diff(np.append(first, len(text)))
        for language, key, count, at in zip(languages[text[first]].tolist(), keys[text[first]].tolist(), n.tolist(), offset[first].tolist()):
            total, *pointer = self.languages.get(language, (0, key, at))
            self.languages[language] = (total + count, *min((key, at), tuple(pointer)))
        self.segment = segment
        self.words += len(segment)
        self.texts += len(keys)

    def full(self, most: int) -> bool:
        return self.grams >= most or self.words >= 2 * most

    def counted(self) -> list[np.ndarray]:
        """fp, check, n, key, at: at holds the offset and the size. The pointer of an n-gram leads to the
        text of the smallest key that holds it, so the pointers of many n-grams meet in few texts."""
        number, text, offset = (np.concatenate(x) for x in zip(*self.per_word))
        key, language = (np.concatenate(x) for x in zip(*self.per_text))
        fingerprint, check, at, size = (np.concatenate(x) for x in zip(*self.per_gram))
        self.per_word, self.per_gram = [], []
        rank = np.empty(len(key), np.int64)
        rank[np.argsort(key, kind="stable")] = np.arange(len(key))
        order = np.argsort(fingerprint)
        new = _changes(fingerprint[order])
        if _changes(check[order])[~new].any():      # fingerprints clash
            order = np.lexsort((check, fingerprint))
            new = _changes(fingerprint[order]) | _changes(check[order])
        first = np.flatnonzero(new)
        self._verify(order, first, at, size, language[text[at]], number)
        columns = [np.empty(0, np.int64)] * 5
        if len(first):
            pointer = np.minimum.reduceat((rank[text[at[order]]] << 32) + at[order], first) & ((1 << 32) - 1)
            leader = order[first]
            columns = [fingerprint[leader], check[leader], np.diff(np.append(first, len(order))), key[text[pointer]],
                       offset[pointer] << 3 | size[leader]]
        speech = np.array(list(self.languages), np.uint64)
        n, where, place = (np.array(x, np.int64) for x in zip(*self.languages.values()))
        whole = [self.segment.fingerprints(np.zeros(len(speech), np.int64), 0, speech, f) for f in (0, 1)]
        return [np.concatenate([a.view(np.int64), b.view(np.int64)]) for a, b in zip(columns, (*whole, n, where, place << 3))]

    @staticmethod
    def _verify(order, first, at, size, language, number) -> None:
        """All n-grams of a group have the words of its first one."""
        if not len(order):
            return
        leader = np.repeat(order[first], np.diff(np.append(first, len(order))))
        same = (size[order] == size[leader]).all() and (language[order] == language[leader]).all()
        for j in range(int(size.max())):
            longer = size[order] > j
            same = same and (number[at[order[longer]] + j] == number[at[leader[longer]] + j]).all()
        if not same:
            raise RuntimeError("two n-grams have the same fingerprint and check")


_COUNTED = ["fp", "check", "n", "key", "at"]


def _combine(counted: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Counts of the same (fp, check) summed, with a pointer into the text of the smallest key; sorted by fp."""
    # of one kind before they meet: signed and unsigned integers of 64 bits would become doubles
    fp, check, n, key, at = (np.concatenate([c.view(kind) for c in x]) for x, kind in zip(zip(*counted), (np.uint64, *[np.int64] * 4)))
    order = np.argsort(fp)
    new = _changes(fp[order])
    if _changes(check[order])[~new].any():
        order = np.lexsort((check, fp))
        new = _changes(fp[order]) | _changes(check[order])
    first = np.flatnonzero(new)
    group, key = np.cumsum(new) - 1, key[order]
    leads = np.flatnonzero(key == np.minimum.reduceat(key, first)[group])
    leads = leads[np.diff(group[leads], prepend=-1) != 0]
    return [fp[order[first]], check[order[first]], np.add.reduceat(n[order], first), key[leads], at[order[leads]]]


def _blocks(counted: list[np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """(bucket, fp, check, n, key, at): sorted columns, packed for each bucket."""
    fp = counted[0]
    parts = _ranges(fp, 64 - bucket_bits) if bucket_bits else [(0, 0, len(fp))]
    return pa.RecordBatch.from_arrays([
        pa.array([b for b, _, _ in parts], pa.int64()), pa.array([delta_planes(fp[s:e], 8) for _, s, e in parts], pa.binary()),
        *(pa.array([_planes(c[s:e], 8) for _, s, e in parts], pa.binary()) for c in counted[1:])], names=["bucket", *_COUNTED])


def _count_grams(sizes, shared, bits: int, bucket_bits: int, flush_grams: int, held_rows: int, segment_bytes: int):
    """(key, language, text) -> blocks of (fp, check, n, key, at). All words of a language are counted
    too, as its n-gram of size 0."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, maps, held = _Counter(), shared.value, []
        for segment, keys, languages, text, offset in _segments(batches, bits, segment_bytes):
            counter.add(segment, keys, languages, text, offset, _grams(segment, languages[text], sizes, maps))
            if counter.full(flush_grams):
                held.append(counter.counted())
                counter = _Counter()
                if sum(len(x[0]) for x in held) > held_rows:
                    held = [_combine(held)]
                    if len(held[0][0]) > held_rows // 2:
                        yield _blocks(held[0], bucket_bits)
                        held = []
        if counter.languages:
            held.append(counter.counted())
        if held:
            yield _blocks(_combine(held), bucket_bits)

    return count


def _frequent_grams(min_count: int):
    """Sorted blocks -> (fp, check, n, key, at) of the n-grams that occur `min_count` times or more."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, _COUNTED):
            fp, check, n, key, at = _combine([[from_delta_planes(fp, 8), *(_from_planes(x, 8) for x in rest)] for fp, *rest in rows])
            keep = n >= min_count
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (fp.view(np.int64), check, n, key, at)], names=_COUNTED)

    return merge


def _read(bits: int, segment_bytes: int):
    """(lang, language, text, wanted) -> (lang, size, phrase, n): the phrases that the pointers lead to."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            every, bound = _text_bytes(batch.column("text"))
            pointers = batch.column("wanted")
            first = np.concatenate([[0], np.cumsum(pointers.value_lengths().to_numpy())])
            fields = [pointers.flatten().field(i).to_numpy() for i in range(4)]
            for i, (lang, language) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("language").to_pylist())):
                data = every[bound[i]:bound[i + 1]]
                at, n, fp, check = (c[first[i]:first[i + 1]] for c in fields)
                for start, end in cuts(data, segment_bytes):
                    here = np.flatnonzero((at >> 3 >= start) & (at >> 3 < end))
                    if not len(here):
                        continue
                    segment = Segment(data[start:end], bits)
                    place, sizes = np.searchsorted(segment.start, (at[here] >> 3) - start), at[here] & 7
                    for size in np.unique(sizes):
                        mine = sizes == size
                        speech = np.full(mine.sum(), language, np.int64).view(np.uint64)
                        for family, known in enumerate((fp, check)):
                            if (segment.fingerprints(place[mine], int(size), speech, family).view(np.int64) != known[here[mine]]).any():
                                raise RuntimeError("two texts have the same 64-bit key")
                        out += [(lang, int(size), segment.phrase(p, int(size)), m) for p, m in zip(place[mine].tolist(), n[here[mine]].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                                 names=["lang", "size", "phrase", "n"])

    return read


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, count_words: int = COUNT_WORDS, flush_grams: int = FLUSH_GRAMS,
                     segment_bytes: int = SEGMENT_BYTES, fingerprint_bits: int = FINGERPRINT_BITS,
                     bitmap_bits: int = BITMAP_BITS, bucket_words: int = BUCKET_WORDS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Per language and phrase of 1 to `max_words` words (7 at most) that occurs `min_count` times or
    more: lang, size, phrase, n. The empty phrase (size 0) counts all words of a language.

    Whole texts are read, A-Z lower-cased; null texts count as empty, a null language is `und`.
    Repeated rows count each time; very long texts are read in parts that end where a piece ends.
    """
    if not 2 <= max_words <= 7:
        raise ValueError("phrases of 2 to 7 words")
    spark = docs.sparkSession
    lang = F.coalesce(F.col(f"`{lang_col}`"), F.lit("und"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("key"), F.xxhash64(lang).alias("language"))
    lines = rows.select("key", "language", F.concat("text", F.lit("\n")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), size // (6 * bucket_words))
    bucket_bits = (parts - 1).bit_length()
    kind = F.col("bucket")

    levels, maps = [(1,), (2,), tuple(range(3, max_words + 1))], {}
    for level, sizes in enumerate(filter(len, levels), 1):
        shared = spark.sparkContext.broadcast(maps)
        blocks = lines.mapInArrow(_count_slots(sizes, shared, fingerprint_bits, bucket_bits, min_count, count_words, segment_bytes),
                                  "bucket long, slots binary, n binary")
        found = materialize(blocks.repartition(parts, kind).sortWithinPartitions("bucket")
                            .mapInArrow(_frequent_slots(min_count), "slot long"))
        maps = maps | {level: _bitmap(found, bitmap_bits)}
    shared = spark.sparkContext.broadcast(maps)
    blocks = lines.mapInArrow(_count_grams(tuple(range(1, max_words + 1)), shared, fingerprint_bits, bucket_bits, flush_grams, held_rows, segment_bytes),
                              "bucket long, " + ", ".join(f"`{c}` binary" for c in _COUNTED))
    found = materialize(blocks.repartition(parts, kind).sortWithinPartitions("bucket").mapInArrow(
        _frequent_grams(min_count), ", ".join(f"`{c}` long" for c in _COUNTED)))

    # at most as many pointers lead to a text as it has n-grams
    wanted = found.groupBy("key").agg(F.collect_list(F.struct("at", "n", "fp", "check")).alias("wanted"))
    needed = found.select("key").distinct()
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = rows.join(side, "key", "left_semi").groupBy("key").agg(
        F.first("lang").alias("lang"), F.first("language").alias("language"), F.first("text").alias("text"))
    return materialize(texts.join(wanted, "key").mapInArrow(_read(fingerprint_bits, segment_bytes),
                                                            "lang string, size int, phrase string, n long"))


def _parts(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, percent: int = PERCENT, top: int = TOP, **counting) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Of a phrase's cuts the one with the lowest score counts, ties to the shortest first part; a
    phrase that lies inside a longer candidate of at least `percent` % of its count is left out.
    Scores are computed in 38-digit integers. An empty table gives an empty result.
    """
    counts = frequent_phrases(docs, text_col, lang_col, min_count, max_words, **counting)
    part = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    words, size = F.col("words"), F.col("size")

    cut = candidates.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), _parts(words, F.lit(1), k).alias("first"), _parts(words, k + 1, size - k).alias("rest")))).alias("cut"))
    cut = (cut.select("lang", "phrase", "a", "cut.*")
           .join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
           .join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
           .join(F.broadcast(counts.where("size = 0").select("lang", "n")) if counts.where("size = 0").count() <= BROADCAST_ROWS
                 else counts.where("size = 0").select("lang", "n"), "lang"))
    big = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000 * {big.format('a')} * {big.format('n')}) DIV ({big.format('l')} * {big.format('r')})")
    scored = (cut.withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("least")).select("lang", "phrase", "least.*"))

    # the inner phrases of every longer candidate
    inner = candidates.where("size > 2").select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("size"))
    inner = (inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1),
                                                            lambda i: _parts(words, i, size))).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer", "k"))
    # in two steps, so that a language's last task sees at most `top` phrases of each bucket
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    buckets = partitions(docs.sparkSession)
    best = (kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = """
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
listed AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM listed, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q
  JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN cand b ON b.lang = s.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a
   AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least ANTI JOIN longer USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
