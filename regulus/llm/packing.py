"""Packing documents into sequences of a fixed number of tokens.

Texts become token ids once, in the tasks that read them; what is shuffled for
packing is the length of each piece. Pieces arrive at a task in an order drawn
by a hash, some thousand at a time, and are placed once and for all, the longest
of those at hand first. A bitset has a bit for each free space that some open
bin has, so the tightest bin for a piece is the lowest bit at or above its
length. The number of open bins is fixed: where a piece needs a new one and all
are open, the fullest closes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import cut, few

#: Tokens to a sequence; the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces that one task packs; those at hand at once; open bins of a task.
PER_TASK, AT_HAND, OPEN_BINS = 100_000, 10_000, 4096
#: Entries of each half of a worker's two caches.
CACHED = 250_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """A bounded cache of a function: when it is full, it is kept as the older half of a new one."""

    def __init__(self, make: Callable[[str], bytes], most: int = CACHED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.older = {}


class WordEncoder:
    """The ids of a text as little-endian 32-bit integers, equal to the tokenizer's own.

    White space ends a token, so a text's ids are those of its runs without
    white space, one after the other; runs are met again and again and are
    cached. A run of letters, of digits and of signs from ASCII and Latin-1 is
    taken apart as the vocabulary's splitting rule says and its parts go to the
    BPE model; any other run goes to the tokenizer as it is.
    """

    SEPARATORS, ASCII_SPACE = re.compile("[\x1c-\x1f]"), re.compile(r"[ \t\n\r\x0b\x0c]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PART = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.runs, self.parts = Recent(self.run), Recent(self.part)
        self.signs: dict[str, str] = {}

    def part(self, text: str) -> bytes:
        as_bytes = text if text.isascii() else "".join(map(self.sign, text))
        ids = [x.id for x in self.tokenizer.model.tokenize(as_bytes)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def sign(self, letter: str) -> str:
        """A letter's bytes in the alphabet of byte-level vocabularies."""
        if letter not in self.signs:
            self.signs[letter] = self.byte_level.pre_tokenize_str(letter)[0][0]
        return self.signs[letter]

    def run(self, text: str) -> bytes:
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, self.PART.findall(text.lower())))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        # the information separators are white space to Python and not to the tokenizer
        runs = text.split() if not self.SEPARATORS.search(text) else filter(None, self.ASCII_SPACE.split(text))
        return b"".join(map(self.runs.__getitem__, runs))

    def forget(self) -> None:
        """Empties the caches."""
        self.runs.forget()
        self.parts.forget()


@cache
def encoder(path: str) -> WordEncoder:
    """One for each worker; a task leaves its caches empty, as workers live on and run other operators' tasks."""
    return WordEncoder(path)


def forgetting(encode: WordEncoder, batches: Iterable) -> Iterator:
    """The batches, after which the encoder's caches are emptied."""
    try:
        yield from batches
    finally:
        encode.forget()


def pieces(docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and the end, cut only where longer than a sequence."""
    path = path or vocabulary()

    def each(batches):
        encode = encoder(path)
        end = struct.pack("<I", END)
        for b in forgetting(encode, few(batches)):
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1)):
                ids = encode(t.as_py() or "") + end
                for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    at.append(i)
                    rows.append((p, s // 4, len(part) // 4, crc32(part), part if with_ids else None))
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            names = [id_column, "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(made[: 5 + with_ids], names=names[: 5 + with_ids])

    rows = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(each, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class OpenBins:
    """Best fit into a bounded number of open bins."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The number of the bin, and the place in it."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            at = self.take(free)
        else:
            if self.open >= self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
            free, at, self.made = self.capacity, self.made, self.made + 1
        if left := free - length:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return at


def place(rows: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PER_TASK, at_hand: int = AT_HAND) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    rows = cut(rows)
    tasks = max(1, -(-rows.count() // per_task))
    key, names = rows.columns[0], rows.columns
    drawn = F.xxhash64(key, "piece", "ids_crc32")
    mixed = rows.repartition(tasks, drawn).sortWithinPartitions(drawn, F.desc("length"), key, "piece", "ids_crc32")
    lengths = names.index("length")

    def some(batches):
        """The rows that are at hand at once, the longest first."""
        held, n = [], 0
        for b in batches:
            for k in range(0, len(b), at_hand):
                held.append(b.slice(k, at_hand))
                n += len(held[-1])
                if n >= at_hand:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def each(batches):
        bins, task = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for t in some(batches):
            longest = np.argsort(-t.column(lengths).to_numpy(), kind="stable")
            b = t.take(pa.array(longest)).combine_chunks().to_batches()[0]
            placed = [bins.place(n) for n in b.column(lengths).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return mixed.mapInArrow(each, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: where in the document it is, and where in which sequence.

    Null and empty texts are documents of the end alone. Rows that repeat are
    packed each, null ids stay null, other columns are not looked at, an empty
    table gives an empty result. The order of rows does not matter.
    """
    return place(pieces(docs, text, id_column, capacity, path, with_ids), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from a packing with ids: the ids of each sequence, at most its capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def unpack(ids: bytes) -> Iterator[int]:
    return iter(struct.unpack(f"<{len(ids) // 4}I", ids))
