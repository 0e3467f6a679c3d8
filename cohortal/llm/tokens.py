"""Operator 7, token-ID output: ids in canonical length-limited Huffman code, from global counts.

1. Every text is encoded once; ids go to a scratch table and are counted over all documents.
2. Code lengths of at most MAX_BITS come from the counts (package-merge); codes are canonical, so the lengths
   alone describe them.
3. Documents are range-partitioned and sorted by id; each partition is a run of segments. A segment holds
   whole documents: their ids as one bit string, and the bit offset of every BLOCK-th id.
4. Reading decodes the blocks of a segment independently, by one table of 2**MAX_BITS entries.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.memory import tidy
from cohortal.llm.scratch import Scratch

END_ID = 2
MAX_BITS = 16
BLOCK = 256  # ids between two checkpoints
SEGMENT_IDS = 1 << 18  # a segment is closed when it has as many ids
PART_TOKENS = 8_000_000  # ids in a range partition, on average
TEXTS_AT_ONCE = 2000  # that a task gets from Spark
CACHE_PIECES = 1 << 20  # different pieces that a worker keeps
MOST_IDS = 1 << 20  # the largest vocabulary whose counts and lengths go to the driver
VOCABULARY = "byte_bpe_50k.json"

# Byte-level BPE first splits a text by a pattern: runs of letters, of digits, of other marks, each with a space before
# it, and white space. A text is cut where the pattern ends a token whatever else the text holds, and each cut
# piece encodes on its own:
# - before a space whose next character is surely no white space;
# - before and after a line feed between two such characters;
# - between letters, digits and marks of ASCII and Latin, but not after an apostrophe (contractions).
# Nothing is cut inside or beside other scripts; there a piece lies between two such spaces.
LETTER, DIGIT, MARK = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)  # of ASCII, and of the first byte of U+00C0 to U+023F
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[c for c in range(33, 127) if not _KIND[c]]] = MARK
_KINDS = _KIND.tobytes()
_SOLID = bytes(c in range(33, 127) or c in range(0xC3, 0xE1) or c in range(0xE4, 0xF5) for c in range(256))  # first bytes of characters that are no white space
KEY_BYTES = 16  # of a piece that the table of pieces can hold
# the byte alphabet of such models: printable characters of Latin-1 stand for themselves, the others for those from U+0100 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = np.arange(256, dtype="<u2")
_ALPHABET[sorted(set(range(256)) - _PRINTABLE)] = 256 + np.arange(256 - len(_PRINTABLE))
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first bytes of a little-endian word
SLICE_BYTES = 3 << 19  # of text that is cut and looked up at once


def cuts(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in UTF-8 text at which pieces begin, and whether each piece is one token of the pattern: a run of
    one kind, a space before it or not. starts are those of the documents, which are cut anyway."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    raw, kind = np.frombuffer(text, dtype=np.uint8), np.frombuffer(bytearray(text.translate(_KINDS)), dtype=np.uint8)
    solid = np.frombuffer(text.translate(_SOLID), dtype=bool)
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8))
    after = raw[lead + 1]
    kind[lead + 1] = LETTER
    sign = lead[(raw[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))]  # the signs of multiplication and division
    kind[sign] = kind[sign + 1] = 0
    out = np.zeros(n + 1, dtype=bool)
    out[: n - 1] = (raw[:-1] == 32) & solid[1:]
    line = np.flatnonzero(raw[1:-1] == 10) + 1
    line = line[(kind[line - 1] > 0) & solid[line + 1]]
    out[line] = out[line + 1] = True
    left, right = kind[:-1], kind[1:]
    out[1:n] |= (left != right) & (left > 0) & (right > 0) & (raw[:-1] != 39)
    out[starts[starts < n]] = True
    out[n] = False
    start = np.flatnonzero(out)
    other = np.cumsum((kind == 0) | (raw == 39), dtype=np.int32)  # up to each byte, itself included
    last = np.append(start[1:], n) - 1
    first = raw[start]
    return start, (other[last] == other[start]) & ((first == 32) & (last > start) | (kind[start] > 0) & (first != 39))


class PieceTable:
    """An open-addressed table from pieces of at most KEY_BYTES bytes to numbers; whole batches are looked up and put at once."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most - 1).bit_length())
        self.low, self.high = (np.zeros(1 << self.bits, dtype=np.uint64) for _ in range(2))
        self.value = np.full(1 << self.bits, -1, dtype=np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + (high ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        return (((h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it has none."""
        out = np.full(len(low), -1, dtype=np.int32)
        at, rest = self._slot(low, high), None
        while len(at):
            found = self.value[at]
            mine = (self.low[at] == low) & (self.high[at] == high) & (found >= 0)
            if rest is None:
                out = np.where(mine, found, -1)
            else:
                out[rest[mine]] = found[mine]
            more = np.flatnonzero(~mine & (found >= 0))
            rest = more if rest is None else rest[more]
            at, low, high = (at[more] + 1) & ((1 << self.bits) - 1), low[more], high[more]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Enters pieces that are all different and not there yet."""
        at = self._slot(low, high)
        while len(at):
            free = np.flatnonzero(self.value[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.low[at[won]], self.high[at[won]], self.value[at[won]] = low[won], high[won], value[won]
            lost = np.ones(len(at), dtype=bool)
            lost[won] = False
            at, low, high, value = (at[lost] + 1) & ((1 << self.bits) - 1), low[lost], high[lost], value[lost]


class Encoder:
    """Token ids of texts, by the tokenizers library; pieces seen before come from a bounded table."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.kind = id_type(max(self.tool.get_vocab(with_added_tokens=True).values()))
        self.most = most
        self._forget(most)

    def _forget(self, room: int) -> None:
        self.room, self.table, self.held = room, PieceTable(room), 0
        self.n, self.at = (np.zeros(room, dtype=np.int32) for _ in range(2))  # ids of a piece, and where they begin
        self.pool, self.filled = np.zeros(4 * room, dtype=self.kind), 0

    def plain(self, text: str) -> bytes:
        return np.array(self._ids([text])[0], dtype=self.kind).tobytes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, low: np.ndarray, high: np.ndarray, ids: list[list[int]]) -> None:
        """Keeps the ids of different pieces; the caller has seen that there is room."""
        size = np.array([len(x) for x in ids], dtype=np.int64)
        need = self.filled + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(need - len(self.pool), len(self.pool) // 2), dtype=self.kind)))
        self.pool[self.filled : need] = np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=need - self.filled)
        now = slice(self.held, self.held + len(ids))
        self.n[now], self.at[now] = size, self.filled + np.cumsum(size) - size
        self.table.put(low, high, np.arange(now.start, now.stop, dtype=np.int32))
        self.held, self.filled = now.stop, need

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, little-endian, as wide as the vocabulary asks for; a null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offset = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        text = texts.buffers()[2][offset[0] : offset[-1]].to_pybytes() if offset[-1] > offset[0] else b""
        whole = np.zeros(len(texts), dtype=bool)
        for mark in ("\0", *self.special):  # keys end in zero bytes
            if mark.encode() in text:
                whole |= pc.match_substring(texts, mark.encode()).to_numpy(zero_copy_only=False)
        edge = offset - offset[0]
        start, simple = cuts(text, edge[:-1])
        size = np.diff(np.append(start, len(text)))
        raw = np.frombuffer(text + bytes(KEY_BYTES), dtype=np.uint8)
        wide = np.ndarray((len(text) + 9,), "<u8", raw, 0, (1,))
        low = wide[start] & _HEAD[np.minimum(size, 8)]
        high = wide[np.minimum(start + 8, len(text))] & _HEAD[np.clip(size - 8, 0, 8)]
        short = size <= KEY_BYTES
        if len(wholes := np.flatnonzero(whole)):
            short &= ~whole[np.searchsorted(edge, start, side="right") - 1]
        place = np.flatnonzero(short)
        full = len(place) == len(start)
        low, high = (low, high) if full else (low[place], high[place])
        number = self.table.get(low, high)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new = _first_of_each(low[lost], high[lost])
            if self.held + len(new) > self.room:  # a new table begins with the pieces of this slice
                lost, new = np.arange(len(number)), _first_of_each(low, high)
                self._forget(max(self.most, len(new)))
            first = lost[new]
            # a token of the pattern goes to the model at once, in the byte alphabet; other pieces to the tokenizer
            tokenize, alphabet = self.model.tokenize, _ALPHABET[raw].tobytes().decode("utf-16-le")
            for one in (True, False):
                some = first[simple[place[first]] == one]
                for k in range(0, len(some), 20_000):
                    at = some[k : k + 20_000]
                    begin = start[place[at]]
                    spans = zip(begin.tolist(), (begin + size[place[at]]).tolist(), strict=True)
                    ids = [[t.id for t in tokenize(alphabet[a:b])] for a, b in spans] if one else self._ids([text[a:b].decode() for a, b in spans])
                    self._learn(low[at], high[at], ids)
            number[lost] = self.table.get(low[lost], high[lost])
        length, begin = (np.zeros(len(start), dtype=np.int32) for _ in range(2))  # a slice has fewer than 2**31 ids
        length[place], begin[place] = self.n[number], self.at[number]
        pool = self.pool
        long = np.flatnonzero(size > KEY_BYTES)
        if len(wholes):
            long = long[~whole[np.searchsorted(edge, start[long], side="right") - 1]]
        if len(long):
            ids = self._ids([text[a : a + n].decode() for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)])
            length[long] = [len(x) for x in ids]
            begin[long] = self.filled + np.cumsum(length[long]) - length[long]
            pool = np.concatenate((self.pool[: self.filled], np.fromiter(chain.from_iterable(ids), dtype=self.kind)))
        stop = np.cumsum(length, dtype=np.int32)
        ids = pool[np.arange(stop[-1] if len(stop) else 0, dtype=np.int32) + np.repeat(begin - (stop - length), length)].tobytes()
        width = np.dtype(self.kind).itemsize
        ends = (np.concatenate(([0], stop))[np.searchsorted(start, edge)] * width).tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for k in wholes.tolist():
            out[k] = self.plain(texts[k].as_py().decode())
        return out


def _first_of_each(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where each different pair stands first in the order of the pairs."""
    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    return order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]]


def id_type(most: int) -> str:
    """The numpy type of ids up to `most`."""
    return "<u2" if most < 1 << 16 else "<u4"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch whose strings in that column have about `most` bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids binary, n): the ids of each whole text and the end id. A null text is empty."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        end = np.array([end_id], dtype=tool.kind)
        wide, end = end.itemsize, end.tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                ids = [x + end for x in tool.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([len(x) // wide for x in ids], pa.int64())], names=["doc_id", "ids", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n long")


def count_ids(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; each task sends a row an id at most."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                found = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=kind), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 2**most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)  # a package's weight; ties may fall either way, sums stay optimal
    n = len(leaf)
    rows, level = [], leaf
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaf, pairs))
        at = np.argsort(both, kind="stable")
        rows.append(at < n)
        level = both[at]
    take = 2 * n - 2
    found = np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(rows):
        leaves = int(is_leaf[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    found[:take] += 1
    lengths[order] = found
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray, most: int = MAX_BITS):
        self.lengths, self.most = lengths, most
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.left_shift(np.uint64(1), (most - lengths[order]).astype(np.uint64))
        first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(span)[:-1])) if len(order) else np.zeros(0, np.uint64)
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = first >> (most - lengths[order]).astype(np.uint64)
        self.symbol_at, self.bits_at = np.zeros(1 << most, dtype=np.uint32), np.ones(1 << most, dtype=np.int64)
        if len(order):
            filled = int(span.sum())
            self.symbol_at[:filled] = np.repeat(order, span.astype(np.int64))
            self.bits_at[:filled] = np.repeat(lengths[order].astype(np.int64), span.astype(np.int64))

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes]:
        """The bit string of ids, and the bit offset (32 or 64 bits wide, little-endian) of each block."""
        if not len(ids):
            return b"", b""
        bits = self.lengths[ids].astype(np.int64)
        start = np.cumsum(bits) - bits
        word = start >> 5
        value = self.codes[ids] << (64 - (start & 31) - bits).astype(np.uint64)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        at = word[begin]  # codes are shorter than a word, so that every word has one that begins in it
        out[at] += np.add.reduceat(value >> np.uint64(32), begin)
        out[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), begin)
        return out.astype(">u4").tobytes(), start[::block].astype("<u8").tobytes()

    def unpack(self, bits: bytes, offsets: bytes, n: int, block: int = BLOCK) -> np.ndarray:
        """The ids again: all blocks advance side by side, one table look-up an id."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        half = np.frombuffer(bits, dtype=">u2").astype(np.uint32)
        pair = (half << np.uint32(16)) | np.concatenate((half[1:], np.zeros(1, np.uint32)))
        at = np.frombuffer(offsets, dtype="<u8").astype(np.int64)
        out = np.zeros((block, len(at)), dtype=np.uint32)
        last = len(pair) - 1
        for k in range(min(block, n)):
            seen = (pair[np.minimum(at >> 4, last)] >> (16 - (at & 15)).astype(np.uint32)) & np.uint32(0xFFFF)
            out[k] = self.symbol_at[seen]
            at = at + self.bits_at[seen]
        return out.T.reshape(-1)[:n]


SEGMENT_SCHEMA = "part int, segment int, first long, n long, doc_ids array<long>, doc_n array<long>, bits binary, offsets binary"


def write_segments(encoded: DataFrame, kind: str, lengths: np.ndarray, path: str, parts: int) -> None:
    """Writes encoded(doc_id, ids, n) in ascending order of doc_id; equal ids in the order of their content."""
    code_of = lengths.tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = Code(np.frombuffer(code_of, dtype=np.uint8)), TaskContext.get().partitionId()
        docs: list[tuple[int, np.ndarray]] = []
        held = first = number = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in docs])
            bits, offsets = code.pack(ids)
            row = ([part], [number], [first], [len(ids)], [[d for d, _ in docs]], [[len(x) for _, x in docs]], [bits], [offsets])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "segment", "first", "n", "doc_ids", "doc_n", "bits", "offsets"])

        for batch in batches:
            for doc, ids in zip(batch.column(0), batch.column(1), strict=True):
                docs.append((doc.as_py(), np.frombuffer(ids.as_py(), dtype=kind)))
                held += len(docs[-1][1])
                if held >= SEGMENT_IDS:
                    yield close()
                    docs, first, number, held = [], first + held, number + 1, 0
        if docs:
            yield close()

    ordered = encoded.select("doc_id", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str, lengths: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files; start counts the ids of all documents before."""
    files = spark.read.parquet(path)
    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    code_of = lengths.tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(code_of, dtype=np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("part", "first", "n", "doc_ids", "doc_n", "bits", "offsets")}
                data = code.unpack(row["bits"], row["offsets"], row["n"]).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_n"])
                starts = ends - row["doc_n"]
                ids = [data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"] + before[row["part"]], pa.int64()), pa.array(row["doc_n"], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return files.select("part", "first", "n", "doc_ids", "doc_n", "bits", "offsets").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def with_checksums(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of each document's ids as they were read."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> np.ndarray:
    """Writes the ids of docs(doc_id, text) under path and returns the code lengths that read them.

    A null or empty text is the end id alone; a null doc_id comes first; rows that repeat an id are written
    each, in the order of a hash of their ids; an empty table writes no segment. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    path_of = tokenizer or tokenizer_path()
    kind = encoder(path_of).kind
    with scratch.batches(TEXTS_AT_ONCE):
        encoded = scratch.table(encode_documents(docs, path_of), "ids")
    found = count_ids(encoded, kind).limit(MOST_IDS + 1).collect()
    if len(found) > MOST_IDS:
        raise ValueError(f"over {MOST_IDS} different ids")
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    write_segments(encoded, kind, lengths, path, max(8, -(-int(counts.sum()) // PART_TOKENS)))
    scratch.drop("ids")
    scratch.release()
    return lengths


def tokens_of(docs: DataFrame) -> DataFrame:
    """Writes the ids of docs and reads the files back: (doc_id, start, n_tokens, ids_crc32)."""
    out = Scratch(docs.sparkSession, "token-files")
    lengths = write_tokens(docs, out.path("segments"))
    return with_checksums(read_segments(docs.sparkSession, out.path("segments"), lengths))


def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
