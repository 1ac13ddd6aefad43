"""Alignment of two tokenizers over a corpus by a cogroup of postings.

Every document's pairs of linked ids become postings, packed by batch of documents and id of side A. They are shuffled by that
id in sorted streams: first the counts of all batches, which give each pair's documents and the id's maximum, then the
postings, each of which adds to its documents. Contributions are packed again and summed by document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import materialize, small_batches

#: Texts are cut at a single space between characters that are neither white space nor control: both tokenizers end a token there,
#: as no pattern of A and no piece of B goes on over it.
_EDGE = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u2581\u3000\ufeff]"
_CUT = re.compile(f"(?<={_EDGE}) (?={_EDGE})")
#: Pieces that a single space joins to a text which is cut there again. B reads U+2581 as a space, so pieces with it would spoil a text.
_JOINS = re.compile(rf"{_EDGE}(?:[^\u2581]*{_EDGE})?")
#: Characters of text, and documents, of a batch (document numbers within it take 16 bits).
BATCH_CHARS, BATCH_DOCS = 4_000_000, 16_384
#: Pieces of text whose alignment a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 250_000, 200
#: Pieces encoded as one text.
TOGETHER = 64
#: Bytes of postings of one id that a task streams; more are dealt over several tasks, each of which gets all counts.
ID_BYTES = 16_000_000
#: Documents whose sums a task holds before it hands them on.
HELD_DOCS = 2_000_000


def byte_table() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for U+0100 and on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table = byte_table()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = {i: w.encode() if w in special else bytes(table[c] for c in w) for w, i in self.a.get_vocab().items()}
        pieces = range(self.b.get_piece_size())
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.sizes_b = np.array([len(b) for b in self.bytes_b])
        #: ids written out with what follows them: of A within a group and at its side's end, of B likewise
        self.said = [f"{i}{after}" for after, sizes in zip(",|,;", (self.sizes_a, self.sizes_a, self.sizes_b, self.sizes_b), strict=True) for i in range(len(sizes))]
        self.said_sizes = np.array([len(w) for w in self.said])

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of space+text by A, and of text by B."""
        left = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return list(zip(left, self.b.encode(texts, num_threads=1), strict=True))

    def sound(self, encoded: list[tuple[list[int], list[int]]], whole: list[bytes]) -> list[bool]:
        """Which texts both sides' tokens spell."""
        spelt_a, spelt_b = self.bytes_a, self.bytes_b
        return [b"".join([spelt_a[i] for i in a]) == w == b"".join([spelt_b[i] for i in b]) for (a, b), w in zip(encoded, whole, strict=True)]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Numbers(dict):
    """Pieces of text by number, in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Memory:
    """Alignments of pieces of text by number: tokens of A and B, groups and links, the groups written out, and all pieces' links in a row."""

    def __init__(self, tool: Aligner):
        self.tool = tool
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.counts: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.groups: list[str] = []
        self.bad: set[int] = set()

    def learn(self) -> None:
        """Align the pieces that have a number and nothing else, all in one row of bytes, and write out their groups, each ended by a semicolon.

        Two tokens overlap in just one stretch between neighbouring ends of either side, so the stretches are the links;
        ends of both sides end groups.
        """
        tool, first = self.tool, len(self.groups)
        new = list(islice(self.number, first, None))
        if not new:
            return
        good, encoded = self._encode(new)
        self.bad.update(first + k for k in set(range(len(new))).difference(good))
        counts, written = np.zeros((len(new), 4), np.int64), [""] * len(new)
        if good:
            ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in zip(*encoded, strict=True))
            ends_a, ends_b = np.cumsum(tool.sizes_a[ids_a]), np.cumsum(tool.sizes_b[ids_b])
            last = np.cumsum([1 + len(new[k].encode("utf-8", "surrogatepass")) for k in good])
            is_a, is_b = np.zeros((2, last[-1] + 1), bool)
            is_a[ends_a] = is_b[ends_b] = True
            both, cuts = is_a & is_b, np.flatnonzero(is_a | is_b)
            upto_a, upto_b, upto_both = (np.cumsum(x, dtype=np.int32) for x in (is_a, is_b, both))
            pairs = ids_a[upto_a[cuts] - is_a[cuts]] << 16 | ids_b[upto_b[cuts] - is_b[cuts]]
            upto = np.stack([upto_a[last], upto_b[last], upto_both[last]], 1)
            upto = np.column_stack([upto, upto[:, 0] + upto[:, 1] - upto[:, 2]])
            counts[good] = np.diff(upto, axis=0, prepend=np.zeros((1, 4), upto.dtype))
            # links in a row follow the numbers, as counts do
            order = np.argsort(good)
            sizes = counts[good, 3][order]
            self.links.append(pairs[np.repeat((upto[:, 3] - counts[good, 3])[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())])
            # a group's A tokens, then its B tokens: an A token comes after the B tokens of the groups before, a B token after the A tokens up to its group
            common, places, n = np.flatnonzero(both), np.empty(len(ids_a) + len(ids_b), np.int64), len(tool.sizes_a)
            places[np.arange(len(ids_a)) + np.concatenate(([0], upto_b[common]))[upto_both[ends_a] - both[ends_a]]] = ids_a + np.where(both[ends_a], n, 0)
            places[np.arange(len(ids_b)) + upto_a[common][upto_both[ends_b] - both[ends_b]]] = 2 * n + ids_b + np.where(both[ends_b], len(tool.sizes_b), 0)
            row = "".join(map(tool.said.__getitem__, places.tolist()))
            at = np.cumsum(tool.said_sizes[places])[upto[:, 0] + upto[:, 1] - 1].tolist()
            for k, x, y in zip(good, chain((0,), at), at, strict=False):
                written[k] = row[x:y]
        self.counts.append(counts)
        self.groups += written

    def _encode(self, new: list[str]) -> tuple[list[int], list[tuple[list[int], list[int]]]]:
        """The sound pieces, in some order, and the ids of both sides of texts that are made of them in that order.

        Pieces are encoded many in a text, with the space between them at which a text is cut. Where a side spells other bytes than
        space+text, and for pieces that don't join so, fewer make a text, at last one; those that then have other bytes are bad.
        """
        tool, good, found = self.tool, [], []
        joining = [k for k, p in enumerate(new) if len(p) <= LONGEST and _JOINS.fullmatch(p)]
        left = [joining[x : x + TOGETHER] for x in range(0, len(joining), TOGETHER)] + [[k] for k in set(range(len(new))).difference(joining)]
        while left:
            parts, left = left, []
            texts = [" ".join([new[k] for k in part]) for part in parts]
            encoded = tool.encode(texts)
            for part, ids, fine in zip(parts, encoded, tool.sound(encoded, [b" " + t.encode("utf-8", "surrogatepass") for t in texts]), strict=True):
                if fine:
                    good += part
                    found.append(ids)
                elif len(part) > 1:
                    step = max(len(part) // 8, 1)
                    left += [part[x : x + step] for x in range(0, len(part), step)]
        return good, found

    def forget(self) -> None:
        """Between batches: all, once there are too many, else only long pieces."""
        if len(self.number) > REMEMBERED or any(len(p) > LONGEST for p in self.number):
            self.clear()


def _postings(memory: Memory, texts: list[str | None]) -> tuple[list[tuple], list[tuple]]:
    """Of a batch: per text its five columns, and per A id (id, B ids and their documents, documents and their multiplicities)."""
    numbers = [[*map(memory.number.__getitem__, _CUT.split(t))] if t else [] for t in texts]
    memory.learn()
    counts, groups, docs = np.concatenate([np.zeros((0, 4), np.int64), *memory.counts]), memory.groups, []
    at_doc, at_piece = [], []
    for k, ids in enumerate(numbers):
        if not ids or not memory.bad.isdisjoint(ids):
            docs.append((0, 0, 0, 0, ""))
            continue
        docs.append((*counts[ids].sum(0).tolist(), hashlib.sha256("".join([groups[i] for i in ids])[:-1].encode()).hexdigest()))
        at_piece.append(np.array(ids, np.int64))
        at_doc.append(np.full(len(ids), k, np.int64))
    if not at_doc:
        return docs, []
    used, times = np.unique(np.concatenate(at_piece) << 16 | np.concatenate(at_doc), return_counts=True)
    piece, doc = used >> 16, used & 0xFFFF
    sizes = counts[piece, 3]
    starts = np.cumsum(counts[:, 3]) - counts[:, 3]
    flat = np.concatenate(memory.links)
    pairs = flat[np.repeat(starts[piece] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    keys = pairs << 16 | np.repeat(doc, sizes)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], np.repeat(times, sizes)[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    weights, keys = np.add.reduceat(weights, first), keys[first]
    pairs, doc = keys >> 16, (keys & 0xFFFF).astype("<u2")
    bounds = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1], [True])))
    heads = pairs[bounds[:-1]]
    ids_b, n_docs = (heads & 0xFFFF).astype("<u2").tobytes(), np.diff(bounds).astype("<u4").tobytes()
    ids_a = heads >> 16
    cuts = np.flatnonzero(np.concatenate(([True], ids_a[1:] != ids_a[:-1], [True]))).tolist()
    docs_bytes, out = doc.tobytes(), []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        x, y = int(bounds[lo]), int(bounds[hi])
        times_here = weights[x:y]
        packed = times_here.astype("<u1" if times_here.max() < 256 else "<u8").tobytes()
        out.append((int(ids_a[lo]), ids_b[2 * lo : 2 * hi], n_docs[4 * lo : 4 * hi], docs_bytes[2 * x : 2 * y], packed))
    return docs, out


def _encode(path_a: str, path_b: str, id_type: pa.DataType):
    fields = [("kind", pa.int8()), ("batch", pa.int64()), ("at", pa.int32()), ("n_docs", pa.int32()), ("doc_id", id_type), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
    fields += [(n, pa.binary()) for n in ("ids_b", "counts", "docs", "times")]
    schema = pa.schema(fields)

    def rows(batch: int, memory: Memory, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        docs, postings = _postings(memory, texts)
        memory.forget()
        n, m = len(docs), len(postings)
        blank = (None,) * m
        columns = list(zip(*docs, strict=True)) or [()] * 5
        packed = list(zip(*postings, strict=True)) or [()] * 5
        held = [[0] * n + [1] * m, [batch] * (n + m), [*range(n), *packed[0]], [n] * (n + m), [*ids, *blank]]
        held += [[*c, *blank] for c in columns] + [[None] * n + list(p) for p in packed[1:]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(aligner(path_a, path_b))
        batch = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for part in batches:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH_CHARS or len(ids) == BATCH_DOCS:
                    yield rows(batch, memory, ids, texts)
                    ids, texts, size, batch = [], [], 0, batch + 1
        if ids:
            yield rows(batch, memory, ids, texts)

    return run


_SUMS = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("best", pa.binary()), ("sums", pa.binary())])


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by (a, salt, tag): of each id first its counts, then its postings. Gives sums of batches of documents."""
    documents, now, touched, highest, ready = np.zeros(1 << 16, np.int64), None, [], 0, False
    held: dict[int, np.ndarray] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for batch, sums in held.items():
            at = np.flatnonzero(sums[1])
            rows.append((batch, at.astype("<u2").tobytes(), sums[0, at].tobytes(), sums[1, at].tobytes()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMS, strict=True)], schema=_SUMS)

    for part in batches:
        names = ("a", "salt", "tag", "batch", "n_docs", "ids_b", "counts", "docs", "times")
        for a, salt, tag, batch, n_docs, ids_b, counts, docs, times in zip(*(part.column(n).to_pylist() for n in names), strict=True):
            ids, n = np.frombuffer(ids_b, "<u2"), np.frombuffer(counts, "<u4")
            if (a, salt) != now:
                for x in touched:
                    documents[x] = 0
                now, touched, ready = (a, salt), [], False
            if not tag:
                documents[ids] += n
                touched.append(ids)
                continue
            if not ready:
                highest, ready = max(int(documents[x].max()) for x in touched), True
            doc = np.frombuffer(docs, "<u2")
            many = np.frombuffer(times, "<u1" if len(times) == len(doc) else "<u8").astype(np.float64)
            count = np.repeat(documents[ids], n)
            if batch not in held:
                held[batch] = np.zeros((2, n_docs), np.int64)
                size += n_docs
            held[batch][0] += np.bincount(doc, np.where(count == highest, many, 0), n_docs).astype(np.int64)
            held[batch][1] += np.bincount(doc, many * count, n_docs).astype(np.int64)
            if size > HELD_DOCS:
                yield flush()
                size = 0
    if held:
        yield flush()


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _total(id_type: pa.DataType):
    """Over a partition sorted by (batch, tag): the documents of a batch, then what was added to them."""
    schema = pa.schema([("doc_id", id_type), *((n, pa.int64()) for n in _COLUMNS), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, sums = None, None

        def done() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            at = list(columns[0])
            columns = [columns[1], *columns[2:6], sums[0, at], sums[1, at], columns[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for part in batches:
            names = ("batch", "tag", "n_docs", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "docs", "best", "sums")
            for batch, tag, n_docs, *doc, at, best, added in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                if batch != now:
                    if rows:
                        yield done()
                    now, rows = batch, []
                    sums = np.zeros((2, n_docs), np.int64)
                if not tag:
                    rows.append(tuple(doc))
                    continue
                where = np.frombuffer(at, "<u2")
                sums[0, where] += np.frombuffer(best, np.int64)
                sums[1, where] += np.frombuffer(added, np.int64)
        if rows:
            yield done()

    return run, ", ".join(f"{n} long" for n in _COLUMNS)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row.

    A encodes space+text, B text; paths are those of the vocabulary files on every executor. Tokens link where their byte
    ranges overlap; a pair's count is the number of rows that hold it linked, copies included. Null and empty texts, and texts of which a side has
    other bytes than space+text, have no tokens: zeros and ''. Whole texts of any length; repeated rows and null ids stay;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    packed = f"kind byte, batch long, at int, n_docs int, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids_b binary, counts binary, docs binary, times binary"
    with small_batches(docs.sparkSession):
        table = materialize(docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b, id_type), packed), "postings")
        postings = table.where("kind = 1").select(F.col("at").alias("a"), "batch", "n_docs", "ids_b", "counts", "docs", "times")
        heavy = postings.groupBy("a").agg(F.ceil(F.sum(F.octet_length("docs") + F.octet_length("times")) / ID_BYTES).cast("int").alias("salts")).where("salts > 1")
        salted = postings.join(F.broadcast(heavy), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))  # no more rows than A has ids
        none = F.lit(None).cast("binary")
        counts = salted.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), "batch", "n_docs", "ids_b", "counts", none.alias("docs"), none.alias("times"))
        rows = salted.select("a", F.pmod(F.xxhash64("batch"), "salts").cast("int").alias("salt"), F.lit(1).alias("tag"), "batch", "n_docs", "ids_b", "counts", "docs", "times")
        streams = counts.unionAll(rows).repartition("a", "salt").sortWithinPartitions("a", "salt", "tag")
        added = materialize(streams.mapInArrow(_contribute, "batch long, docs binary, best binary, sums binary"), "contributions")
    own = table.where("kind = 0").select("batch", F.lit(0).alias("tag"), "n_docs", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = own.unionByName(added.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    run, columns = _total(id_type)
    return both.repartition("batch").sortWithinPartitions("batch", "tag").mapInArrow(run, f"doc_id {kind.simpleString()}, {columns}, groups_sha256 string")
