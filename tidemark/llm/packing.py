"""Packing of tokenised documents into sequences of a fixed length.

Documents are tokenised and cut into pieces in one pass; only the pieces' numbers
travel from there. Pieces are dealt by hash into groups of bounded size. A group
is packed best-fit in order of falling length, then improved by local search: one-for-one
exchanges, two-for-one exchanges and moves between sequences that are not full, each raising the
sum of squared fills, until sequences fall empty and no change is left. What
the groups leave in sequences that are not full is dealt anew and packed again, until one group
holds it all or a round saves less than one sequence in a thousand.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups
from .store import Table
from .text import slices

#: Pieces in a group, on average.
GROUP_PIECES = 16_384
#: Another round of packing must be worth so many of the sequences that are not full.
LEAST_GAIN = 0.001
#: Sequence ids that a group may use.
_GROUP_IDS = 1 << 20
_CACHE_ENTRIES = 1 << 18
#: Characters for which the quick way below is tested to agree with the tokenizer: none of them is
#: changed by NFC, and white space, letters and numbers among them are the same in every Unicode version.
_UNTESTED = re.compile("[^\\t-\\r -~\\xa0-\\u017f]")
# Fixed value: the vocabulary file's pre-tokenizer pattern, with its letters (\p{L}), numbers (\p{N}) and
# white space written out for the tested range, for which the standard library's engine is the faster one.
_LETTER, _NUMBER, _BLANK = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9²³¹¼½¾", "\t-\r \xa0"
_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
_SPECIAL = "<|"


def byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level BPE writes for each byte: the byte's own where it has one, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """Little-endian 32-bit token ids of texts, by a word-level BPE vocabulary file.

    Its words are independent of each other, so ids are remembered word by word;
    texts with characters outside the tested range go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.words: dict[str, bytes] = _Words(self._word)

    def _word(self, word: str) -> bytes:
        """Ids of one lower-cased match of the pattern: the model alone, without the steps that cut texts into words."""
        spelled = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(spelled)])

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if _SPECIAL in text or _UNTESTED.search(text):
            return self._plain(text)
        return b"".join(map(self.words.__getitem__, _PATTERN.findall(text.lower())))


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        value = self.encode(word)
        if len(word) <= 64:
            if len(self) >= _CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def _pieces(batches: Iterator[pa.RecordBatch], *, tokenizer: str, length: int, separator: int) -> Iterator[pa.RecordBatch]:
    encode = WordTokenizer(tokenizer)
    end, step = int(separator).to_bytes(4, "little"), 4 * length
    for batch in slices(batches):
        ids, rows = batch.column("doc_id").to_pylist(), []
        for doc_id, text in zip(ids, batch.column("text").to_pylist()):
            raw = (encode.ids(text) if text else b"") + end
            for piece, low in enumerate(range(0, len(raw), step)):
                part = raw[low : low + step]
                rows.append((doc_id, piece, low // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes of `sizes`, which fall: each goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for k, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, place = capacity, len(bins)
            bins.append([])
        bins[place].append(k)
        left = room - size
        if left:
            by_room.setdefault(left, []).append(place)
            rooms |= 1 << left
    return bins


class Search:
    """Changes between the bins of `bins` (indexes of `sizes`) that are not full.

    A change gives a taker one or two items of a giver, for one of its own or for none, so that the taker
    becomes fuller than the giver was: that is when the sum of squared fills rises, so the search ends by itself.
    All items of all takers are weighed at once; an item of size 0 in each bin stands for none.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        fills = [sum(sizes[k] for k in b) for b in bins]
        self.capacity = capacity
        self.full = [b for b, fill in zip(bins, fills) if fill == capacity]
        left = [b for b, fill in zip(bins, fills) if fill < capacity]
        self.items = np.array([k for b in left for k in b] + [-1] * len(left), dtype=np.int64)
        self.size = np.array([sizes[k] for b in left for k in b] + [0] * len(left), dtype=np.int64)
        self.bin = np.array([n for n, b in enumerate(left) for _ in b] + list(range(len(left))), dtype=np.int64)
        self.fill = np.bincount(self.bin, weights=self.size, minlength=len(left)).astype(np.int64)
        self.of: list[list[int]] = [[] for _ in left]  # places in `items`, without those of size 0
        for place, number in enumerate(self.bin[: len(self.bin) - len(left)].tolist()):
            self.of[number].append(place)
        self.changes = 0

    def _shrink(self) -> None:
        """Keeps only items of bins that are neither full nor empty among those that are weighed."""
        fill = self.fill[self.bin]
        self.live = np.flatnonzero((fill > 0) & (fill < self.capacity))
        self.live_size, self.live_bin = self.size[self.live], self.bin[self.live]

    def _gain(self, sums: np.ndarray, room: np.ndarray, above: np.ndarray) -> tuple[int, int, int]:
        """(gain, place among the weighed, place in `sums`) of the greatest gain: a sum less the item given back, above a bound and at most the taker's room."""
        at = np.searchsorted(sums, self.live_size + room, side="right") - 1
        gain = sums[np.maximum(at, 0)] - self.live_size
        gain = np.where((at >= 0) & (gain > above), gain, 0)
        k = int(gain.argmax())
        return int(gain[k]), k, int(at[k])

    def change(self, giver: int) -> bool:
        """Makes the change of this giver that fills a taker most; false if none raises the sum of squared fills."""
        mine = sorted(self.of[giver], key=self.size.__getitem__)
        given = self.size[mine]
        before = self.fill[self.live_bin]
        room = self.capacity - before
        # A taker must end fuller than the giver is now; the giver itself cannot.
        above = np.where(self.live_bin == giver, self.capacity, np.maximum(0, self.fill[giver] - before))
        gain, k, at = self._gain(given, room, above)
        out = [mine[at]] if gain > 0 else []
        if len(mine) > 1 and (gain <= 0 or gain < room[k]):
            # Two largest of each size are enough, as no change takes more.
            few = [n for n in range(len(mine)) if n < 2 or given[n] != given[n - 2]]
            i, j = (np.array(few)[x] for x in np.triu_indices(len(few), 1))
            sums = given[i] + given[j]
            order = np.argsort(sums, kind="stable")
            more, k2, at2 = self._gain(sums[order], room, above)
            if more > gain:
                gain, k, out = more, k2, [mine[i[order[at2]]], mine[j[order[at2]]]]
        if gain <= 0:
            return False
        taker = int(self.live_bin[k])
        back = [int(self.live[k])] if self.live_size[k] else []
        for places, source, target in ((out, giver, taker), (back, taker, giver)):
            for place in places:
                self.of[source].remove(place)
                self.of[target].append(place)
                self.bin[place] = target
        self.fill[taker] += gain
        self.fill[giver] -= gain
        self.live_bin = self.bin[self.live]
        self.changes += 1
        return True

    def run(self) -> list[list[int]]:
        """Every bin gives, the emptiest first, over and over until none has a change left or no fewer could hold all."""
        least = -(-int(self.fill.sum()) // self.capacity)
        moved = True
        while moved and np.count_nonzero(self.fill) > least:
            moved = False
            for giver in np.argsort(self.fill, kind="stable").tolist():
                if not 0 < self.fill[giver] < self.capacity:
                    continue
                self._shrink()
                while self.fill[giver] and self.change(giver):
                    moved = True
                if np.count_nonzero(self.fill) <= least:
                    break
        return self.full + [[int(self.items[place]) for place in places] for places in self.of if places]


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins after a local search that ends where no change is left, or where no fewer bins could hold all."""
    return Search(bins, sizes, capacity).run()


def _pack(batches: Iterator[pa.RecordBatch], *, length: int, first_id: int) -> Iterator[pa.RecordBatch]:
    for table in groups.runs(batches, "group"):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("number", "ascending")])
        sizes = table["length"].to_pylist()
        bins = improve(best_fit(sizes, length), sizes, length)
        first = first_id + table["group"][0].as_py() * _GROUP_IDS
        sequence, offset, is_open = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
        for number, members in enumerate(bins):
            at = 0
            for k in members:
                sequence[k], offset[k] = first + number, at
                at += sizes[k]
            is_open[members] = at < length
        yield pa.RecordBatch.from_arrays(
            [*(table[c].combine_chunks() for c in _COLUMNS), pa.array(sequence), pa.array(offset), pa.array(is_open)],
            [*_COLUMNS, "sequence_id", "offset", "is_open"],
        )


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, *, tokenizer: str, length: int = 4096, separator: int = 1, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of a document of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids (no special tokens added) and `separator`; only
    longer ones than `length` are cut, into pieces of `length` and a rest.
    Sequences hold at most `length` tokens and have no gaps.

    Defined cases: a null text is an empty one, so one piece of one token; null
    doc_ids are kept; repeated rows are documents of their own; an empty table
    gives an empty table; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = texts.mapInArrow(partial(_pieces, tokenizer=tokenizer, length=length, separator=separator), _PIECE)
    # The number tells pieces of repeated rows apart, which would all be dealt into one group.
    left = Table(cut.withColumn("number", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in _COLUMNS if c != "number"] + ["sequence_id", "offset"]
    done: list[DataFrame] = []
    turn, first_id, before, last = 0, 0, None, None
    while True:
        pieces, tokens = left.df.agg(F.count(F.lit(1)), F.sum("length")).first()
        dealt = max(1, min(-(-pieces // group_pieces), (tokens or 0) // length))  # a group has a sequence's worth of tokens at least
        group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number", F.lit(turn)), F.lit(dealt))
        grouped = left.df.withColumn("group", group).repartition("group").sortWithinPartitions("group")
        packed = Table(grouped.mapInArrow(partial(_pack, length=length, first_id=first_id), f"{_PIECE}, number long, sequence_id long, offset long, is_open boolean"), "packed")
        left.drop()
        starts = packed.df.where("offset = 0")  # one in each sequence
        total, still = starts.agg(F.count(F.lit(1)), F.count_if("is_open")).first()
        if before is not None and total > before:  # the round before had packed these pieces better
            packed.drop()
            return reduce(DataFrame.unionAll, [*done, last.df.where("is_open").select(columns)])
        if last is not None:
            done.append(last.df.where("NOT is_open").select(columns))
        if dealt == 1 or still < 2 or before is not None and before - total < LEAST_GAIN * before:
            return reduce(DataFrame.unionAll, [*done, packed.df.select(columns)])
        left = Table(packed.df.where("is_open").select(_COLUMNS), "pieces")
        turn, first_id, before, last = turn + 1, first_id + dealt * _GROUP_IDS, still, packed
