"""Best-fit packing by exact complements.

Tokenised documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths reaches the
driver: at most `capacity` rows, whatever the corpus. The plan is made on it. From the longest length on, the gap
each sequence leaves is looked up as one length, a sum of two, or a sum of three, and as many sequences are closed at
once as the available counts allow; what finds no exact complement is placed best-fit into the open gaps. A plan row
places a run of equal-length pieces (by rank) at one offset of a run of consecutive sequences, so the plan has a
size bounded by the capacity too, and it is joined to the ranked pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import materialize, small_batches

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers; beyond it the memory starts anew.
MEMORY_WORDS = 200_000
#: Bytes of text taken together.
BATCH_BYTES = 500_000
#: Pieces of one length that are ranked in one group.
RANK_ROWS = 500

#: Byte kinds: 0 white space, 1 letters and digits, 2 marks that always part from those, 3 all else.
_KIND = np.full(256, 3, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts by the tokenizer's own model, as little-endian bytes, remembering words.

    White space always parts tokens here and is dropped, so the ids of a text are those of its chunks in order.
    The steps before the model are done on the chunk (NFC, lower case, the file's split pattern, byte letters), and
    the pieces not yet known go to the model together, parted again at the tokens that end a word. A chunk with
    characters whose lower case depends on their place, or with a special token's string, goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = {s["type"]: s for s in spec["pre_tokenizer"]["pretokenizers"]}
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        suffix = spec["model"]["end_of_word_suffix"]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and set(steps) == {"Split", "ByteLevel"} and bool(suffix)
        self.split = regex.compile(steps["Split"]["pattern"]["Regex"]).findall if self.known else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {}

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_pieces(self, new: list[str]) -> None:
        mapped = [p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(self.letters) for p in new]
        ids = np.array(self.bare.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(new):
            raise ValueError("the model's words do not all end in the end-of-word suffix")
        raw, at = ids.tobytes(), (4 * at).tolist()
        self.chunks.update(zip(new, (raw[i:j] for i, j in zip([0, *at], at, strict=False)), strict=True))

    def learn(self, new: list[str]) -> None:
        import unicodedata

        parts = {}
        for chunk in new:
            if not self.known or "<|" in chunk or not chunk.isprintable():
                self.chunks[chunk] = self.whole(chunk)
            elif chunk.isascii():
                low = chunk.lower()
                parts[chunk] = [low] if low.isalpha() else self.split(low)
            elif chunk.isalpha() and max(chunk) < "\u0250" and "İ" not in chunk:
                parts[chunk] = [chunk.lower()]
            elif max(chunk) < "\u0250" and "İ" not in chunk:
                parts[chunk] = self.split(unicodedata.normalize("NFC", chunk).lower())
            else:
                self.chunks[chunk] = self.whole(chunk)
        known = self.chunks  # a piece alone is a chunk too
        if missing := list({p for found in parts.values() for p in found if p not in known}):
            self.learn_pieces(missing)
        for chunk, found in parts.items():
            if len(found) != 1 or found[0] != chunk:
                known[chunk] = b"".join([known[p] for p in found])

    def look_up(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and the number of ids of each word. Each distinct word is looked up once."""
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.chunks) > MEMORY_WORDS:
            self.chunks.clear()
        self.learn([c for c in distinct if c not in self.chunks])
        raw = list(map(self.chunks.__getitem__, distinct))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, first = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[at]
        return ids[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text (null: none), texts taken together up to BATCH_BYTES."""
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // BATCH_BYTES
        for rows in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                yield from self._encode(pc.fill_null(texts.slice(rows[0], len(rows)), ""), lengths[rows])

    def _encode(self, texts: pa.StringArray, lengths: np.ndarray) -> list[bytes]:
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        begin = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)[0]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin : begin + offsets[-1]]
        row = np.repeat(np.arange(len(lengths)), lengths)
        easy = np.full(len(lengths), self.known)
        easy[row[raw >= 0xC4]] = False  # beyond Latin-1
        easy &= ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        # Lower case of Latin-1: A-Z, and the second byte of À to Þ but for ×.
        low = _LOWER[raw]
        accented = np.concatenate(([False], raw[:-1] == 0xC3)) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        low[accented] += 0x20
        low = np.where(easy[row], low, raw)
        kind = _KIND[low]
        kind[accented | (np.concatenate(([False], raw[:-1] == 0xC3)) & (low >= 0x98) & (low != 0xB7))] = 1
        kind[:-1][(raw[:-1] == 0xC3) & (kind[1:] == 1)] = 1
        kind[~easy[row] & (kind > 0)] = 3
        space = kind == 0
        opens = np.ones(len(low), bool)
        opens[1:] = space[:-1] | (row[1:] != row[:-1]) | (kind[1:] * kind[:-1] == 2)
        opens &= ~space
        starts = np.flatnonzero(opens)
        letters = low[~space]
        ends = np.append((np.cumsum(~space) - 1)[starts], len(letters)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()))
        ids, n = self.look_up(words)
        total = np.cumsum(np.bincount(row[starts], n, len(lengths)).astype(np.int64)).tolist()
        out = ids.tobytes()
        return [out[4 * i : 4 * j] for i, j in zip([0, *total], total, strict=False)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32); a null or empty text is the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.string())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class SumIndex:
    """Single, pair and triple sums of the given lengths, under counts that only fall.

    For each sum up to the capacity, `pairs` holds the larger halves of the pairs that make it, largest first, built
    once; `at` points to the first that is still to be had. A triple is a length and a pair of the rest, so its sums
    are found in the same tables: `third` holds for each sum the largest length that may still be part of a triple.
    As counts only fall, what is passed over once never comes back, and all pointers together move a bounded number of times.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for k, n in counts.items():
            self.left[k] = n
        lengths = np.flatnonzero(self.left)
        self.pairs = [np.zeros(0, np.int16)] * 2
        for total in range(2, capacity + 1):
            x = lengths[(2 * lengths >= total) & (lengths < total)]
            self.pairs.append(x[self.left[total - x] > 0][::-1].astype(np.int16))
        self.at = [0] * (capacity + 1)
        self.lengths = lengths[::-1].tolist()
        self.third = np.searchsorted(-lengths[::-1], 2 - np.arange(capacity + 1)).tolist()

    def _live(self, total: int, begin: int, used: int = 0) -> int:
        """Index of the first pair from `begin` on that is to be had beside one piece of length `used`; the number of pairs if none is."""
        x = self.pairs[total][begin:]
        y = total - x
        left_x, left_y = self.left[x] - (x == used), self.left[y] - (y == used)
        live = (left_x > 0) & (left_y > (x == y))
        return begin + int(live.argmax()) if live.any() else len(self.pairs[total])

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair that makes total, its larger half as large as can be."""
        if total < 2:
            return None
        at = self.at[total] = self._live(total, self.at[total])
        if at == len(self.pairs[total]):
            return None
        x = int(self.pairs[total][at])
        return x, total - x

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """A triple that makes total, its largest part as large as can be."""
        while self.third[total] < len(self.lengths):
            x = self.lengths[self.third[total]]
            if 3 * x < total:
                return None
            rest = total - x
            if self.left[x] and self.pair(rest):
                begin = max(self.at[rest], int(np.searchsorted(-self.pairs[rest], -x)))
                at = self._live(rest, begin, x)
                if at < len(self.pairs[rest]):
                    y = int(self.pairs[rest][at])
                    return x, y, rest - y
            self.third[total] += 1
        return None

    def complement(self, total: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that make total exactly."""
        if self.left[total] > 0:
            return (total,)
        return self.pair(total) or self.triple(total)


class Plan:
    """Rows (length, first_rank, last_rank, first_sequence, place): the piece of rank r goes to first_sequence + r - first_rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.sums = SumIndex({k: v for k, v in counts.items() if v}, capacity)
        self.used: dict[int, int] = defaultdict(int)
        self.rows, self.sequences = [], 0

    def take(self, length: int, n: int, sequence: int, place: int) -> None:
        at = self.used[length]
        self.rows.append((length, at, at + n - 1, sequence, place))
        self.used[length] += n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan's rows and the number of sequences, from the number of pieces of each length (1 to capacity).

    From the longest length on, the complement of a sequence is looked up among single lengths, pairs and triples, and
    taken as often as the counts of its parts allow; lengths without a complement go best-fit into open gaps.
    """
    p = Plan(counts, capacity)
    left = p.sums.left
    odd: list[tuple[int, int]] = []
    for top in sorted((k for k, v in counts.items() if v), reverse=True):
        while n := int(left[top]):
            if top == capacity:
                left[top] = 0
                p.take(top, n, p.sequences, 0)
                p.sequences += n
                break
            left[top] -= 1  # one at least opens the sequence
            found = p.sums.complement(capacity - top)
            left[top] = 0 if found is None else n
            if found is None:
                odd.append((top, n))
                break
            parts = (top, *found)
            times = min(int(left[x]) // parts.count(x) for x in parts)
            place = 0
            for x in parts:
                left[x] -= times
                p.take(x, times, p.sequences, place)
                place += x
            p.sequences += times
    # Best fit for the rest: gap -> runs (first sequence, number, filled), the fullest sequences first.
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_bits = 0
    for length, n in odd:
        while n:
            fits = open_bits >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                first, many = gaps[gap].pop()
                m = min(n, many)
                if many > m:
                    gaps[gap].append((first + m, many - m))
                if not gaps[gap]:
                    open_bits &= ~(1 << gap)
            else:
                m, gap = n, capacity
                first = p.sequences
                if 2 * length <= capacity:  # each new sequence takes as many of this length as fit
                    m = -(-n // (capacity // length))
                p.sequences += m
            p.take(length, m, first, capacity - gap)
            n -= m
            if gap > length:
                gaps[gap - length].append((first, m))
                open_bits |= 1 << gap - length
    return p.rows, p.sequences


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces -> pieces with sequence_id and offset; every piece once, sequences gapless from 0 and at most `capacity`.

    Pieces of one length are ranked in groups of about RANK_ROWS by hash, so a length that a third of all rows
    share is ranked by many tasks; group counts give each group its first rank. Repeated rows are pieces of their
    own. The histogram and the plan are broadcast: their size is bounded by the capacity.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    groups = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in counts.items()], "length long, groups long")
    mark = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    keyed = cut.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(mark, "groups")).drop("groups")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    firsts = firsts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = keyed.withColumn("place", F.row_number().over(own)).join(firsts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("place") - 1).drop("first", "place", "salt")
    slots = spark.createDataFrame(rows, "slot_length long, low long, high long, sequence long, offset long")
    hit = (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("low"), F.col("high"))
    return ranked.join(F.broadcast(slots), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack; the pieces (numbers only, no ids) are written once between the two passes over them.

    A null or empty text is the end id alone; a text of any length is cut, never dropped; repeated rows and null ids are
    pieces of their own. Only doc_id and text are read, so other columns may have any name; an empty table gives no row.
    """
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack(cut, capacity)
