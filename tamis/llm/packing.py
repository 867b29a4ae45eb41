"""Best-fit-decreasing packing of documents into token sequences.

Best fit looks at lengths alone, and open sequences with the same room are alike. So the packing of all pieces
follows from the number of pieces of each length (at most ``limit`` numbers, whatever the corpus holds): the
driver runs exact best-fit decreasing over that histogram, with a segment tree over remaining capacities that
finds the tightest open sequence in O(log limit). Its plan is a list of runs ("pieces a..b of length l go to
sequences s.. at offset o"), and each piece finds its run from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tamis.llm.common import Scratch, only
from tamis.llm.tokens import CHUNKS, PLAIN, byte_letters

#: Parts that the pieces of one length are ranked in, so that a very common length is no single group.
PARTS = 64


class TokenIds(dict):
    """UTF-8 run without ASCII white space -> its ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def __missing__(self, data: bytes) -> bytes:
        text = data.decode()
        plain = PLAIN.fullmatch(text)
        if plain and "<|" not in text:
            ids = b"".join(map(self.word, (plain[1].lower(), plain[2])))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[data] = ids
        return ids

    def word(self, s: str) -> bytes:
        if not s:
            return b""
        known = self.words.get(s)
        if known is None:
            shown = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            known = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
            if len(self.words) >= CHUNKS // 2:
                self.words.clear()
            self.words[s] = known
        return known

    def of(self, data: bytes) -> bytes:
        if len(self) > CHUNKS * 3 // 4:
            self.clear()
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))


_ids: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _ids:
        _ids[path] = TokenIds(path)
    return _ids[path]


class Capacities:
    """A segment tree over remaining capacities 0..limit; a leaf holds the open sequences with exactly that room, as ranges of ids."""

    def __init__(self, limit: int):
        self.size = 1
        while self.size < limit + 1:
            self.size *= 2
        self.any = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def put(self, room: int, first: int, n: int) -> None:
        if n <= 0:
            return
        self.ranges[room].append((first, n))
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = True
            i //= 2

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        if not self.ranges[room]:
            i = room + self.size
            self.any[i] = False
            i //= 2
            while i:
                self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
                i //= 2
        return found

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least need that an open sequence has."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], limit: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Exact best-fit decreasing over {length: pieces}: for each length its runs (first rank, pieces, first sequence, offset)."""
    open_, runs, fresh = Capacities(limit), {}, 0
    for length in sorted(histogram, reverse=True):
        left, rank, own = histogram[length], 0, []
        while left:
            room = open_.tightest(length)
            if room is None:
                room, first, n = limit, fresh, -(-left // (limit // length))
                fresh += n
            else:
                first, n = open_.take(room)
            each = room // length  # a sequence stays the tightest until the length no longer fits
            whole = min(n, left // each)
            for layer in range(each if whole else 0):
                own.append((rank, whole, first, limit - room + layer * length))
                rank += whole
            left -= whole * each
            open_.put(room - each * length, first, whole)
            if whole < n and left:
                for layer in range(left):
                    own.append((rank, 1, first + whole, limit - room + layer * length))
                    rank += 1
                open_.put(room - left * length, first + whole, 1)
                left, whole = 0, whole + 1
            if room < limit:
                open_.put(room, first + whole, n - whole)
        runs[length] = own
    return runs


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document's ids and the end id, cut where longer than limit."""
    fields = [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in ("piece", "start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def cut(batches):
        known, end, wide = token_ids(tokenizer), np.array([end_id], "<u4").tobytes(), limit * 4
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = known.of(value.as_py() or b"") + end
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    for column, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=False):
                        column.append(x)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<u4").astype("int64"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=[f.name for f in fields])

    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(cut, T.StructType(fields))


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids with with_ids), sequence_id, offset.

    Null texts count as empty: their one piece is the end id. Null ids and repeated rows are packed like any
    others, each row by itself; an empty table gives no rows; other columns of docs take no part. Pieces are
    written once to the shared folder, so texts are encoded once and a lost executor costs no second plan.
    """
    cut = Scratch(pieces(docs, tokenizer, limit, end_id, with_ids), "pieces").df()
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    cut = cut.withColumn("part", part)
    # At most limit * PARTS rows, whatever the corpus holds.
    counts = cut.groupBy("length", "part").count().collect()
    histogram: dict[int, int] = {}
    base = np.zeros((limit + 1, PARTS), "int64")
    for row in sorted(counts, key=lambda r: (r["length"], r["part"])):
        base[row["length"], row["part"]] = histogram.get(row["length"], 0)
        histogram[row["length"]] = histogram.get(row["length"], 0) + row["count"]
    found = {length: np.array(runs, "int64") for length, runs in plan(histogram, limit).items()}

    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(order))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = T.StructType([ranked.schema[n] for n in shown] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            lengths, parts, ranks = (batch.column(n).to_numpy(zero_copy_only=False).astype("int64") for n in ("length", "part", "rank"))
            ranks = ranks - 1 + base[lengths, parts]
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths):
                at, runs = lengths == length, found[int(length)]
                k = np.searchsorted(runs[:, 0], ranks[at], "right") - 1
                sequence[at] = runs[k, 2] + ranks[at] - runs[k, 0]
                offset[at] = runs[k, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in shown), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
