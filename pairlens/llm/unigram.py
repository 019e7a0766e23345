"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a leading white-space marker, and each space becomes one.  Of all ways to cut it into pieces the one of the greatest sum
of log scores is taken; of equal ones, that whose last piece starts first, and so on backwards.  A character without a piece counts
``UNKNOWN`` below the least score and is written as its UTF-8 bytes.  If no piece holds a marker after another character (checked for
the given vocabulary), the best cut of a text is that of its words side by side, so each distinct word of a batch is cut once, and
all words of a batch together, position by position; long words are cut one by one.

The vocabulary is a model file, never trained here; its path is a parameter, read on the driver and sent to the executors (its size
is that of the vocabulary, whatever the data).

Defined cases: null texts have no ids and decode to null; empty texts have no ids and decode to the empty text; any other text
decodes to itself, but for U+2581, which stands for a space and decodes to one; repeated rows are encoded each; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .units import factorized, ragged

MARK, UNKNOWN, LONG, CHUNK = "▁", 10.0, 64, 20_000
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Kinds of pieces in a model file.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file, by id."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            own = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            out.append((own[1].decode("utf-8"), own[2], own[3]))
    return out


@dataclass
class DoubleArray:
    """next state = base[state] + byte + 1, if check says it is this state's; ``value`` is the piece that ends in a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(pieces: dict[bytes, int]) -> DoubleArray:
        items = sorted(pieces.items())
        base, check, value = (array("i", [fill]) * 1024 for fill in (0, -1, -1))
        check[0] = 0
        free, top, pending = 1, 1, [(0, len(items), 0, 0)]
        while pending:
            lo, hi, depth, state = pending.pop()  # the first ``depth`` bytes of pieces lo to hi - 1 lead to this state
            if lo < hi and len(items[lo][0]) == depth:
                value[state] = items[lo][1]
                lo += 1
            if lo == hi:
                continue
            while len(check) < top + 600:
                for x, fill in ((base, 0), (check, -1), (value, -1)):
                    x.extend(array("i", [fill]) * len(x))
            starts = [i for i in range(lo, hi) if i == lo or items[i][0][depth] != items[i - 1][0][depth]]
            labels = [items[i][0][depth] + 1 for i in starts]
            while check[free] >= 0:
                free += 1
            first = max(1, free - labels[0])
            # near the first gap, else behind everything
            at = next((p for p in range(first, first + 40) if all(check[p + x] < 0 for x in labels)), top)
            base[state] = at
            for x in labels:
                check[at + x] = state
            top = max(top, at + labels[-1] + 1)
            pending += [(i, j, depth + 1, at + x) for i, j, x in zip(starts, [*starts[1:], hi], labels, strict=True)]
        return DoubleArray(*(np.array(x[: top + 258], dtype=np.int32) for x in (base, check, value)))


class Tokenizer:
    """``encode_batch`` and ``decode_batch``."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.size = len(pieces)
        most = max((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        least = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        self.scores = np.array([len(p) * most - 0.1 if kind == USER else s for p, s, kind in pieces], dtype=np.float64)
        usable = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p}
        self.trie = DoubleArray.build(usable)
        self.unknown = least - UNKNOWN
        self.unk_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNK), 0)
        bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = np.array([bytes_.get(b, self.unk_id) for b in range(256)], dtype=np.int64)
        self.whole_words = all(MARK not in p.decode().lstrip(MARK) for p in usable)
        out = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() if kind in (NORMAL, USER) else b"" for p, _, kind in pieces]
        self.out_lengths = np.array([len(x) for x in out], dtype=np.int64)
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.lists = None

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _UNITS.findall(marked) if self.whole_words else [marked]

    def cut_one(self, data: bytes) -> list[int]:
        """Ids of the best cut of one unit, byte by byte."""
        if self.lists is None:
            self.lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores))
        base, check, value, scores = self.lists
        n = len(data)
        best, came = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            state, single = 0, False
            for j in range(i, n):
                after = base[state] + data[j] + 1
                if check[after] != state:
                    break
                state = after
                if (v := value[state]) >= 0:
                    single |= j + 1 - i == width
                    if best[i] + scores[v] > best[j + 1]:
                        best[j + 1], came[j + 1] = best[i] + scores[v], (i, v)
            if not single and best[i] + self.unknown > best[i + width]:
                best[i + width], came[i + width] = best[i] + self.unknown, (i, -1)
        out: list[int] = []
        while n:
            i, v = came[n]
            out += [v] if v >= 0 else self.byte_ids[list(data[i:n])][::-1].tolist()
            n = i
        return out[::-1]

    def cut_many(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, number of each unit), for units of at most LONG bytes, all at once."""
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        width = int(size[0])
        text = np.zeros((len(units), width + 5), dtype=np.int64)
        flat = np.frombuffer(b"".join(units), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        text[np.repeat(np.arange(len(units)), size), ragged(np.zeros(len(units), dtype=np.int64), size)] = flat[ragged(starts[order], size)]
        best = np.full((len(units), width + 5), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((len(units), width + 5), dtype=np.int16), np.full((len(units), width + 5), -1, dtype=np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.arange(np.searchsorted(-size, -i, side="left"))  # units longer than i
            lead = text[rows, i]
            rows = rows[lead & 0xC0 != 0x80]
            lead = text[rows, i]
            step = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(len(rows), dtype=bool)
            live, state, j = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), i
            while len(live):
                inside = size[rows[live]] > j
                live, state = live[inside], state[inside]
                after = base[state] + text[rows[live], j] + 1
                held = check[after] == state
                live, state = live[held], after[held].astype(np.int64)
                j += 1
                v = value[state]
                ends = v >= 0
                at, v = live[ends], v[ends]
                single[at] |= step[at] == j - i
                r = rows[at]
                score = best[r, i] + self.scores[v]
                better = score > best[r, j]
                r = r[better]
                best[r, j], came[r, j], piece[r, j] = score[better], i, v[better]
            at = np.flatnonzero(~single)
            r, to = rows[at], i + step[at]
            better = best[r, i] + self.unknown > best[r, to]
            r, to = r[better], to[better]
            best[r, to], came[r, to], piece[r, to] = best[r, i] + self.unknown, i, -1
        # from the ends backwards, an id (or a byte of an unknown character) of every unit at a time
        live, at = np.arange(len(units)), size.copy()
        found_unit, found_id = [], []
        while len(live):
            v, start = piece[live, at].astype(np.int64), came[live, at].astype(np.int64)
            byte = v < 0
            v[byte] = self.byte_ids[text[live[byte], at[byte] - 1]]
            # of an unknown character go the bytes one by one: its start takes over the way back
            last = at - 1
            inner = byte & (last > start)
            came[live[inner], last[inner]], piece[live[inner], last[inner]] = start[inner], -1
            found_unit.append(order[live])
            found_id.append(v)
            at = np.where(byte, last, start)
            live, at = live[at > 0], at[at > 0]
        unit, ids = np.concatenate(found_unit)[::-1], np.concatenate(found_id)[::-1]
        by_unit = np.argsort(unit, kind="stable")
        return ids[by_unit], np.bincount(unit, minlength=len(units))

    def cut(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, number of each)."""
        data = [u.encode("utf-8", "replace") for u in units]
        short = [i for i, u in enumerate(data) if len(u) <= LONG]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(units), dtype=np.int64)
        for a in range(0, len(short), CHUNK):
            own = np.array(short[a : a + CHUNK])
            ids, n = self.cut_many([data[i] for i in own])
            counts[own] = n
            parts.append((np.repeat(own, n), ids))
        for i, u in enumerate(data):
            if len(u) > LONG:
                ids = np.array(self.cut_one(u), dtype=np.int64)
                counts[i] = len(ids)
                parts.append((np.full(len(ids), i), ids))
        if not parts:
            return np.empty(0, dtype=np.int64), counts
        where = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
        return np.concatenate([p[1] for p in parts])[where], counts

    def encode_batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text)."""
        codes, places, units = factorized(map(self.units, texts))
        ids, counts = self.cut(list(units))
        starts = np.cumsum(counts) - counts
        n = np.bincount(places, weights=counts[codes], minlength=len(texts)).astype(np.int64)
        return ids[ragged(starts[codes], counts[codes])].astype(np.int32), n

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lengths = self.out_lengths[ids]
        data = self.out_bytes[ragged(self.out_starts[ids], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b].decode("utf-8", "replace").replace(MARK, " ")[1:] for a, b in zip(ends, ends[1:], strict=False)]


def encode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids, n_tokens of each row; with ``decoded``, also the text that the ids decode to."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_pieces(model_file)))  # arrays, built once; a worker unpacks them once
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decoded)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = sent.value
        for batch in it:
            texts = batch.column(1).to_pylist()
            ids, counts = tokenizer.encode_batch(texts)
            null = np.array([t is None for t in texts], dtype=bool)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int32()), pa.array(ids))
            columns = [batch.column(0), lists, pa.array(counts)]
            if decoded:
                columns.append(pa.array([None if no else t for t, no in zip(tokenizer.decode_batch(ids, counts), null, strict=True)], type=pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(batches, schema)


def decode(rows: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of rows of ids; null ids give a null text, and ids outside the vocabulary raise an error."""
    sent = rows.sparkSession.sparkContext.broadcast(Tokenizer(read_pieces(model_file)))
    schema = T.StructType([rows.schema[key], T.StructField("text", T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = sent.value
        for batch in it:
            lists = batch.column(1).to_pylist()
            counts = np.array([len(x or ()) for x in lists], dtype=np.int64)
            flat = np.array([i for x in lists for i in x or ()], dtype=np.int64)
            out = [None if x is None else t for x, t in zip(lists, tokenizer.decode_batch(flat, counts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=schema.names)

    return rows.select(key, ids).mapInArrow(batches, schema)
