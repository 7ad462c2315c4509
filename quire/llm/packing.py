"""Best-fit packing of token sequences.

Tokenising and packing are apart. Tokenising is a map over documents; packing sees only the lengths of
pieces, as they come. Pieces are dealt evenly to streams, and each stream is packed online in bounded space:
the open bins are kept in a bitset keyed by free space, so that the fullest bin that still has room is the
lowest set bit at or above the piece's length; at most `open_bins` bins are open, and beyond that the fullest
closes first. A stream's pieces come by document; `lookahead` of them wait together, and leave the longest
first (1: none waits). Nothing else is kept, so a stream may be of any length, and its last bins, a few
sequences of room, are what a stream costs.

Cases: a null text is empty and is one piece, the end token alone; a special token's string in a text is that token, as the
tokenizer has it; equal documents are packed separately; an empty table gives an empty result; columns other than doc_id and
text are left out.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import flat, pieces_of, texts, written

STREAM = 65_536  # pieces of a stream, about
OPEN_BINS = 256
LOOKAHEAD = 512  # pieces
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _encoding(path: str):
    """The byte-level BPE of a vocabulary file: (encoding, bytes of each id). The .tiktoken file beside a .json holds the same vocabulary as ranks."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(re.sub(r"\.json$", ".tiktoken", path), "rb"))}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("quire", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


#: A space between two characters that no rule counts as white space begins a new unit: no pre-token of the pattern crosses it.
_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_UNEVEN = f"^ | $| {_BLANK}|{_BLANK} "
CACHED = 150_000  # units whose ids a worker keeps


def _added_tokens(path: str) -> list[dict]:
    """That part of a vocabulary file alone: the whole would leave many small objects in a worker's memory."""
    text = open(path).read()
    at = text.index('"added_tokens"')
    return json.JSONDecoder().raw_decode(text, text.index("[", at))[0]


class UnitIds:
    """The ids of units (a word with the space before it). Each distinct unit of an array is encoded once; the first CACHED of a worker stay."""

    def __init__(self, path: str):
        self.path = path
        self.encoding, self.sizes = _encoding(path)
        self.specials = "|".join(re.escape(t["content"]) for t in _added_tokens(path))
        self.tokenizer = None
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32)

    def encode_special(self, text: str) -> np.ndarray:
        """The ids of a text in which a special token's string stands."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each unit in them, end)."""
        slot = np.fromiter((self.slots.get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(slot < 0)
        names = [units[i] for i in new.tolist()]
        ids = self.encode("a " + " ".join(names))  # one call; the first id is of the letter
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), 1 + np.cumsum([len(u.encode()) + 1 for u in names]), side="left") + 1 if names else np.zeros(0, np.int64)
        stops = stops.astype(np.int64)
        starts = np.concatenate([np.ones(min(1, len(stops)), np.int64), stops[:-1]])
        known = slot >= 0
        begin, end = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        begin[known], end[known] = self.starts[slot[known]], self.ends[slot[known]]
        begin[new], end[new] = starts + len(self.ids), stops + len(self.ids)
        every = np.concatenate([self.ids, ids])
        if len(self.slots) < CACHED and names:
            self.slots.update(zip(names, range(len(self.starts), len(self.starts) + len(names)), strict=True))
            self.ids, self.starts, self.ends = every, np.concatenate([self.starts, begin[new]]), np.concatenate([self.ends, end[new]])
        return every, begin, end


@lru_cache(maxsize=1)
def _units(path: str) -> UnitIds:
    return UnitIds(path)


def token_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, end of each text in them)."""
    known, text = _units(path), flat(text)
    if not len(text):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    special = np.asarray(pc.match_substring_regex(text, known.specials)) if known.specials else np.zeros(len(text), bool)
    uneven = np.asarray(pc.match_substring_regex(text, _UNEVEN)) | special
    parts = pc.split_pattern(text, " ")
    counts = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    units = parts.flatten().dictionary_encode()
    last = np.cumsum(counts)
    firsts = last - counts
    # An empty or blank-edged unit is only in texts that are encoded whole, or at a text's start: any word will do for it here.
    names = pc.if_else(pc.match_substring_regex(units.dictionary, f"^$|^{_BLANK}|{_BLANK}$"), "a", units.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), " ")[0].as_py()
    ids, begins, stops = known.of(joined.split(" "))
    which = np.asarray(units.indices, dtype=np.int64)
    begins, lengths = begins[which], (stops - begins)[which]
    # A text's first unit has no space before it.
    whole = pc.if_else(pa.array(uneven), text, units.dictionary.take(units.indices.take(pa.array(firsts)))).to_pylist()
    heads = [known.encode_special(x) if own else known.encode(x) for x, own in zip(whole, special.tolist(), strict=True)]
    lengths[np.repeat(uneven, counts)] = 0
    lengths[firsts] = [len(h) for h in heads]
    begins[firsts] = len(ids) + np.cumsum(lengths[firsts]) - lengths[firsts]
    ids = np.concatenate([ids, *heads])
    ends = np.cumsum(lengths)
    return ids[np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]))], ends[last - 1]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece. A document longer than the capacity is cut into pieces of full length; only its first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, limit=4 << 20):
                ids, ends = token_ids(part.column("text"), vocabulary)
                at, rows = 0, []
                for doc, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    own = np.append(ids[at:end], np.uint32(end_id)).astype("<u4")
                    at, start, k = end, 0, 0
                    while start < len(own):
                        n = (len(own) - start - 1) % capacity + 1 if not k else capacity
                        rows.append((doc, k, start, n, zlib.crc32(own[start : start + n])))
                        start, k = start + n, k + 1
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


class Bins:
    """Bounded-space best fit, one piece after another. The bit f of `free` is set while a bin with f places free is open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free, self.n_open, self.n_bins = 0, 0, 0
        self.open_at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _pop(self, space: int) -> int:
        own = self.open_at[space].pop()
        if not self.open_at[space]:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return own

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of a piece of length n."""
        if room := self.free >> n:
            space = n + (room & -room).bit_length() - 1
            own = self._pop(space)
        else:
            own, space, self.n_bins = self.n_bins, self.capacity, self.n_bins + 1
        if left := space - n:
            self.open_at[left].append(own)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.most:  # the fullest closes first
                self._pop((self.free & -self.free).bit_length() - 1)
        return own, self.capacity - space


def best_fit(lengths: np.ndarray, capacity: int, open_bins: int = OPEN_BINS, lookahead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given."""
    bins, out = Bins(capacity, open_bins), np.empty((2, len(lengths)), np.int64)
    for at in range(0, len(lengths), lookahead):
        part = lengths[at : at + lookahead]
        for i in np.argsort(-part, kind="stable").tolist():
            out[:, at + i] = bins.place(int(part[i]))
    return out[0], out[1]


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD, stream: int = STREAM) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Rows are dealt in turn, so that no key decides the size of a stream."""
    streams = max(1, -(-pieces.count() // stream))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base, waiting = Bins(capacity, open_bins), TaskContext.get().partitionId() << 32, None

        def placed(part: pa.Table) -> pa.RecordBatch:
            lengths, out = np.asarray(part["length"]), np.empty((2, part.num_rows), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                out[:, i] = bins.place(int(lengths[i]))
            return part.append_column("sequence_id", pa.array(base + out[0])).append_column("offset", pa.array(out[1])).combine_chunks().to_batches()[0]

        for batch in batches:
            waiting = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            whole = waiting.num_rows // lookahead * lookahead
            for at in range(0, whole, lookahead):
                yield placed(waiting.slice(at, lookahead))
            waiting = waiting.slice(whole)
        if waiting is not None and waiting.num_rows:
            yield placed(waiting)

    dealt = pieces.repartition(streams).sortWithinPartitions("doc_id", "piece", "start", "ids_crc32")
    return dealt.mapInArrow(fill, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents cut and packed. The small table of pieces is written, so that texts are tokenised once."""
    return pack(written(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
