"""Best-fit packing: bounded-space online best-fit of tokenised documents into sequences.

A fixed number of bins is open. A Python integer is the bitset: bit f is set while an open bin has f free places.
A piece goes to the open bin with the least free space that still holds it; if none does, a bin is opened, and if
that would be one too many, the fullest open bin closes first. Every task packs the rows of its own partition, so
the operator has no shuffle; sequence numbers carry the partition's number.

Rows: null text counts as empty; an empty document is the end-of-document id alone; a null doc_id stays null;
repeated rows are packed each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mix, read, slices

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: A word of Latin letters with ASCII marks behind it (no apostrophe): the tokenizer cuts it just there.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Texts without apostrophes, of Latin letters, ASCII digits, marks and white space: the tokenizer's own cuts are these.
_SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9\t\n\x0b\x0c\r !-&(-/:-@\[-`{-~]*")
#: Of the bytes of such a text in Latin-1: 0 white space, 1 letter, 2 digit (a piece of its own), 3 mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[list(b"0123456789")] = 2
_CLASS[[i for i in range(256) if chr(i).isalpha() and (i < 128 or i >= 0xC0)]] = 1
#: Texts with it may hold special tokens, which the tokenizer looks for before it cuts: they are encoded whole.
_SPECIAL = "<|"
#: White space for Python's split() that isn't for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Keeps the first n bytes of a little-endian value.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_KEYS = 3
_LONGEST = 8 * _KEYS


class PieceTable:
    """Ids of pieces of at most 24 bytes, looked up for whole arrays: open addressing over the pieces' own bytes."""

    def __init__(self, learn, max_entries: int):
        self.learn, self.max_entries = learn, max_entries
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.zeros((1 << 14, _KEYS), np.uint64)
        self.hash = np.zeros(1 << 14, np.uint64)
        self.at = np.zeros((1 << 14) + 1, np.int64)
        self.ids = np.zeros(1 << 16, "<u4")

    def _find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (h & mask).astype(np.int64)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys).any(axis=1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            got = self.slots[slot[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo]).any(axis=1)]
        return out

    def _fill(self, entries: np.ndarray) -> None:
        mask = np.uint64(len(self.slots) - 1)
        slot = (self.hash[entries] & mask).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.slots[slot[own]] = entries[own]
            rest = np.ones(len(entries), bool)
            rest[own] = False
            entries, slot = entries[rest], (slot[rest] + 1) & int(mask)

    def _add(self, keys: np.ndarray, h: np.ndarray, ids: list[bytes]) -> None:
        new, end = len(keys), self.n + len(keys)
        if end > len(self.hash):
            room = max(end, 2 * len(self.hash))
            for name in ("keys", "hash"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros((room - len(old), *old.shape[1:]), old.dtype)]))
            self.at = np.concatenate([self.at, np.zeros(room + 1 - len(self.at), np.int64)])
        raw = np.frombuffer(b"".join(ids), "<u4")
        begin = int(self.at[self.n])
        if begin + len(raw) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(raw), len(self.ids)), "<u4")])
        self.ids[begin : begin + len(raw)] = raw
        self.keys[self.n : end], self.hash[self.n : end] = keys, h
        self.at[self.n + 1 : end + 1] = begin + np.cumsum([len(x) // 4 for x in ids])
        self.n = end
        if 2 * end > len(self.slots):
            self.slots = np.full(4 * len(self.slots) if 4 * end > 2 * len(self.slots) else 2 * len(self.slots), -1, np.int32)
            self._fill(np.arange(end, dtype=np.int32))
        else:
            self._fill(np.arange(end - new, end, dtype=np.int32))

    def encode(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's ids begin (one more at the end). buf: 24 bytes to spare."""
        if self.n > self.max_entries:
            self.clear()
        wide = np.lib.stride_tricks.sliding_window_view(buf, 8)
        keys = np.empty((len(starts), _KEYS), np.uint64)
        for j in range(_KEYS):
            keys[:, j] = wide[starts + 8 * j].view("<u8")[:, 0] & _FIRST[np.clip(lens - 8 * j, 0, 8)]
        h = mix(keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + mix(keys[:, 1] * np.uint64(0xD6E8FEB86659FD93) + keys[:, 2]))
        found = self._find(keys, h)
        while len(missing := np.flatnonzero(found < 0)):
            _, first = np.unique(h[missing], return_index=True)
            new = missing[first]
            pieces = [buf[s : s + n].tobytes().decode("latin-1") for s, n in zip(starts[new].tolist(), lens[new].tolist(), strict=True)]
            self._add(keys[new], h[new], self.learn(pieces))
            found[missing] = self._find(keys[missing], h[missing])
        begin = self.at[found]
        counts = self.at[found + 1] - begin
        edges = np.r_[0, np.cumsum(counts)]
        return self.ids[np.repeat(begin - edges[:-1], counts) + np.arange(edges[-1])], edges


class Encoder:
    """Token ids as little-endian 32-bit bytes, by pieces that are looked up, with bounded caches.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are those of its words. A
    simple text (`_SIMPLE`) is cut further, by numpy over its bytes, into the tokenizer's own pieces.
    """

    def __init__(self, path: str, max_entries: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.max_entries = max_entries
        self.table = PieceTable(self._each, max_entries)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _each(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the tokenizer doesn't cut, all in one call."""
        got = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        raw, words = np.array(got.ids, "<u4").tobytes(), np.array(got.word_ids, np.int64)
        edges = (4 * np.r_[0, np.cumsum(np.bincount(words, minlength=len(pieces)))]).tolist()
        if len(edges) == len(pieces) + 1:
            return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [self._whole(p) for p in pieces]

    def _learn(self, missing: list[str]) -> None:
        """Words by the simple stem and tail that they are made of, others as a whole."""
        cut = [m.groups() if (m := _PLAIN.fullmatch(w)) else None for w in missing]
        parts = sorted({p for c in cut if c for p in (c[0].lower(), c[1]) if p})
        ids = dict(zip(parts, self._each(parts), strict=True)) if parts else {}
        for w, c in zip(missing, cut, strict=True):
            self.words[w] = ids[c[0].lower()] + ids.get(c[1], b"") if c else self._whole(w)

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.max_entries:
            self.words.clear()
        split = [None if _SPECIAL in t or _ODD_SPACE.search(t) else t.split() for t in texts]
        known = self.words
        if missing := {w for ws in split if ws for w in ws if w not in known}:
            self._learn(sorted(missing))
        get = known.__getitem__
        return [self._whole(t) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split, strict=True)]

    def _encode_simple(self, texts: list[str]) -> list[bytes]:
        raw = [t.lower().encode("latin-1") for t in texts]
        buf = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(_LONGEST), np.uint8)
        kind = _CLASS[buf[:-_LONGEST]]
        change = kind[1:] != kind[:-1]
        digit = kind == 2
        starts = np.flatnonzero((kind > 0) & (np.r_[True, change] | digit))
        lens = np.flatnonzero((kind > 0) & (np.r_[change, True] | digit)) + 1 - starts
        longer = np.flatnonzero(lens > _LONGEST)
        if len(longer):  # these go without the table: their place in the row of ids is filled by hand
            short = np.flatnonzero(lens <= _LONGEST)
            ids, edges = self.table.encode(buf, starts[short], lens[short])
            own: list[bytes] = [b""] * len(starts)
            for i, a, b in zip(short.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own[i] = ids[a:b].tobytes()
            for i in longer.tolist():
                own[i] = self._whole(buf[starts[i] : starts[i] + lens[i]].tobytes().decode("latin-1"))
            ids = np.frombuffer(b"".join(own), "<u4")
            edges = np.r_[0, np.cumsum([len(x) // 4 for x in own])]
        else:
            ids, edges = self.table.encode(buf, starts, lens)
        ends = np.cumsum([len(r) + 1 for r in raw])
        cut = edges[np.r_[0, np.searchsorted(starts, ends)]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        simple = [_SPECIAL not in t and _SIMPLE.fullmatch(t) is not None for t in texts]
        fast = iter(self._encode_simple([t for t, s in zip(texts, simple, strict=True) if s]))
        slow = iter(self._encode_words([t for t, s in zip(texts, simple, strict=True) if not s]))
        return [next(fast if s else slow) for s in simple]


class BestFit:
    """Bounded-space online best-fit; place(length) gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.bits, self.n_open = 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        found = self.by_free[free]
        seq = found.pop()
        if not found:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return seq

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(seq)
            self.bits |= 1 << left
            self.n_open += 1
        return seq, self.capacity - free


_ENCODERS: dict[str, Encoder] = {}


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    max_length: int = 2048,
    open_bins: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise, cut what is longer than max_length, and place every piece.

    One row per piece: SCHEMA, and with with_ids the piece's ids as little-endian unsigned 32-bit `ids`.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        bins = BestFit(max_length, open_bins, TaskContext.get().partitionId() << 40)
        for part in slices(batches, rows=512):
            cols: list[list] = [[] for _ in range(8)]
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, max_length)):
                    length = min(max_length, total - start)
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc, piece, start, length, zlib.crc32(own), *bins.place(length), own)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            arrays = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols[:7])]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[7], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    plain = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return plain.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_tokenizer())
