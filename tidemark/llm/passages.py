"""Passages that recur across documents, near-copies included.

1. Texts that are equal collapse first: one text stands for its copies, whatever their number.
2. A text is a sequence of shingles (hashes of 5 words), and a run is `least` of them in a row.
   Under each hash function the nodes of the Cartesian tree over the hashed shingles whose
   extent holds a run are the text's compact windows: all runs with one minimum. A place is such
   a node exactly if it is the minimum of some run, so the windows are the stretches of equal
   values among the sliding minima, and no tree has to be built.
3. Interval join, inside each text: the windows of two hash functions overlap in stretches of
   runs that have both minima. Both together are the key of a stretch; functions are paired in a ring.
4. All stretches are sorted by key across the cluster, by ranges of key and document, so that a
   frequent key is spread over tasks, and each is linked with the one before it of another
   document: a group of n is n - 1 links, never all pairs. Inside a key, stretches go by the
   minima of the other functions, so that those with more in common meet.
5. Verification: the words around the links of two documents are fetched, and both sides keep the spans
   made of runs whose Jaccard similarity with the same place on the other side reaches the threshold.
6. A stretch may have a copy among others of its group than its neighbours, whatever those confirmed.
   Equal runs have equal minima under all functions, so they lie in stretches of one key: all runs of
   the stretches that share a key of one pair of functions are keyed whole and linked again, and what
   is not in a confirmed span of the two documents yet is verified. Equal keys are equal passages.
7. Groups of three stretches or more that hold an unconfirmed link are compared whole, on the shingles around
   the minima: first each stretch with the group, then those left with each other, until all are in one class.
All steps but the last are linear in the windows, runs or words they read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups
from .graph import components
from .store import Bucketed, Table, buckets, release
from .text import SLICE_BYTES, mixed, shingles, slices, word_hashes, word_starts

#: Words handled at once; a longer text is handled in parts that overlap by a run.
_PART_WORDS = 1 << 17
_PLACE_BITS = np.uint64(24)
_PLACES = np.uint64((1 << 24) - 1)


def sliding_minima(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `least` places, the first place of its least value, by the upper 40 bits, and the value there."""
    n = len(values) - least + 1
    index = np.arange(len(values), dtype=np.uint64)
    low, width = (values & ~_PLACES) | (index & _PLACES), 1
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[least - width : least - width + n])
    start = index[:n]
    place = start + ((low - start) & _PLACES)
    return place.astype(np.int64), values[place]


def _parts(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a run or more, about _PART_WORDS words at once: the batch they came from, the row, first word and length of each part, and all their words' hashes."""
    for batch in slices(batches):
        hashes, counts = word_hashes(batch.column("text"))
        offset = np.cumsum(counts) - counts
        held, count = [], 0
        for row in np.flatnonzero(counts >= run_words).tolist():
            n = int(counts[row])
            for low in range(0, n - run_words + 1, _PART_WORDS):
                held.append((row, low, min(n - low, _PART_WORDS + run_words - 1)))
                count += held[-1][2]
                if count >= _PART_WORDS:
                    yield _part(batch, hashes, offset, held)
                    held, count = [], 0
        if held:
            yield _part(batch, hashes, offset, held)


def _part(batch: pa.RecordBatch, hashes: np.ndarray, offset: np.ndarray, held: list[tuple[int, int, int]]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, low, length = np.array(held, dtype=np.int64).T
    return batch, row, low, length, np.concatenate([hashes[at : at + n] for at, n in zip((offset[row] + low).tolist(), length.tolist())])


def _run_starts(lengths: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the words of several parts put together: where runs start that stay in one part, the part of each, and where parts start."""
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = lengths - run_words + 1
    owner = np.repeat(np.arange(len(lengths)), counts)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + offset[owner]
    return starts, owner, offset


def _seeds(functions: int) -> np.ndarray:
    return mixed(np.arange(1, functions + 1, dtype=np.uint64) << np.uint64(40))


#: A stretch in 64 bits: first run, how many runs follow (fewer than a part has words), and how far the place is from the first run.
_FIRST_BITS, _LAST_BITS = 32, 12


def _packed(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (first << _FIRST_BITS) | ((last - first) << _LAST_BITS) | (place - first)


def _unpacked(name: str) -> dict[str, Column]:
    """The columns first, last and place of a stretch."""
    first = F.shiftright(name, _FIRST_BITS)
    return {"first": first, "last": first + F.shiftright(F.col(name).bitwiseAND(F.lit((1 << _FIRST_BITS) - 1)), _LAST_BITS), "place": first + F.col(name).bitwiseAND(F.lit((1 << _LAST_BITS) - 1))}


def ring(functions: int) -> list[tuple[int, int]]:
    """Each function with the next; at a similarity of s, a share of s of the functions agree, and a pair must.

    One run of 46 shingles at a similarity of 0.8 exactly is met by one of four pairs with a chance of 0.92, an equal one always.
    """
    return [(k, (k + 1) % functions) for k in range(functions if functions > 2 else functions - 1)]


def _windows(batches: Iterator[pa.RecordBatch], *, width: int, least: int, functions: int) -> Iterator[pa.RecordBatch]:
    """Per part of a text and pair of functions, lists of its stretches.

    The upper 48 bits of a key are the two minima. The lower 16 are the other functions' minima in the
    run whose middle is the place, or the nearest one of the stretch.
    """
    seeds, run_words, pairs = _seeds(functions), least + width - 1, ring(functions)
    for batch, row, low, lengths, hashes in _parts(batches, run_words):
        grams = shingles(hashes, width)
        starts, owner, offset = _run_starts(lengths, run_words)
        base = offset - low  # what makes a place one of the text
        found = [sliding_minima(mixed(grams ^ seed), least) for seed in seeds]
        lows = [values[starts] for _, values in found]
        moved = [values[1:] != values[:-1] for values in lows]
        other_part = owner[1:] != owner[:-1]
        columns: list[pa.Array] = []
        for i, j in pairs:
            edge = np.concatenate([[0], np.flatnonzero(moved[i] | moved[j] | other_part) + 1])
            stop = np.concatenate([edge[1:], [len(starts)]]) - 1
            first, last, place, whose = starts[edge], starts[stop], found[i][0][starts[edge]], owner[edge]
            middle = np.clip(place - least // 2, first, last)
            ctx = np.zeros(len(edge), dtype=np.uint64)
            for k in range(functions):
                if k not in (i, j):
                    ctx = mixed(ctx ^ found[k][1][middle])
            key = mixed(mixed(lows[i][edge] + np.uint64(functions * i + j + 1)) ^ lows[j][edge])
            key = (key & ~np.uint64(0xFFFF)) | (ctx & np.uint64(0xFFFF))
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(row)))]).astype(np.int32))
            shift = base[whose]
            columns += [pa.ListArray.from_arrays(cuts, pa.array(values)) for values in (key.view(np.int64), _packed(first - shift, last - shift, place - shift))]
        docs = batch.column("doc").take(pa.array(row))
        yield pa.RecordBatch.from_arrays([docs, *columns], ["doc", *(f"{c}{k}" for k in range(len(pairs)) for c in ("key", "at"))])


_ROW = ["key", "doc", "at"]
_LINK = ["kind", "part", "key", "doc", "at", "partner", "other_at"]
_LINK_SCHEMA = "kind byte, part int, key long, doc long, at long, partner long, other_at long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each row of a sorted partition with the row before it of its key's upper 48 bits and another document, or one of a group's first document with the row after it.

    Kind 0 is a link; kinds 1 and 2 are the partition's first and last rows, which may belong to a group that goes on in another:
    all rows of the last group if they are of one document.
    """
    part = TaskContext.get().partitionId()
    carried: list[np.ndarray] | None = None

    def rows(kind: int, here: list[np.ndarray], there: list[np.ndarray] | None) -> pa.RecordBatch:
        n = len(here[0])
        beside = [pa.array(x) for x in there[1:]] if there else [pa.nulls(n, pa.int64())] * 2
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int8)), pa.array(np.full(n, part, dtype=np.int32)), *map(pa.array, here), *beside], _LINK)

    for batch in batches:
        if not batch.num_rows:
            continue
        here, known = [batch.column(c).to_numpy() for c in _ROW], 0
        if carried is None:
            yield rows(1, [x[:1] for x in here], None)
        else:
            known = len(carried[0])
            here = [np.concatenate(x) for x in zip(carried, here)]
        group, doc = here[0] >> 16, here[1]
        same = group[1:] == group[:-1]
        new_key = np.concatenate([[True], ~same])
        keep = [len(group) - 1]
        if same.any():
            new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
            starts = np.flatnonzero(new_doc)
            number = np.cumsum(new_doc) - 1
            before = np.where(new_key[starts], -1, starts - 1)[number]
            linked = np.flatnonzero(before >= 0)
            linked = linked[linked >= known]
            if len(linked):
                yield rows(0, [x[linked] for x in here], [x[before[linked]] for x in here])
            early = np.flatnonzero(same & (before[1:] < 0))  # a row of the same document follows
            after = np.append(starts, -1)[number[early] + 1]
            early, after = (x[(after >= 0) & ~new_key[after]] for x in (early, after))
            if len(early):
                yield rows(0, [x[after] for x in here], [x[early] for x in here])
            keep = [int(before[-1]), *keep] if before[-1] >= 0 else list(range(int(np.flatnonzero(new_key)[-1]), len(group)))
        carried = [x[keep] for x in here]
    if carried is not None:
        yield rows(2, [x[carried[1] == carried[1][-1]] for x in carried], None)


def _linked(rows: DataFrame) -> tuple[Table, DataFrame]:
    """Links of neighbours in the order of key and document; the second part joins the ends of partitions (two rows each, or a document's repeats)."""
    dealt = rows.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc", "at")
    found = Table(dealt.select(*_ROW).mapInArrow(_neighbours, _LINK_SCHEMA), "links")
    ends = {x: list(y) for x, y in itertools.groupby(sorted(found.df.where("kind > 0").collect(), key=lambda r: (r.part, r.kind)), key=lambda r: (r.part, r.kind))}
    across = [
        (0, b.part, b.key, b.doc, b.at, a.doc, a.at)
        for low, high in itertools.pairwise(ends)
        if (low[1], high[1]) == (2, 1)
        for a in ends[low]
        for b in ends[high]
        if a.key >> 16 == b.key >> 16 and a.doc != b.doc
    ]
    return found, rows.sparkSession.createDataFrame(across, _LINK_SCHEMA)


#: Words of cuts compared at once, in bytes.
_CONFIRM_BYTES = 1 << 19
_CANDIDATE = ["a", "b", "start", "end", "low", "high"]


def candidates(first: np.ndarray, last: np.ndarray, shift: np.ndarray, least: int, reach: int) -> list[tuple[int, int, int, int]]:
    """(start, end exclusive, least and greatest shift) of stretches that overlap at about the same shift, the place here less the place there.

    Each reaches further on both sides than its stretches, whose neighbours may be linked elsewhere.
    """
    out: list[list[int]] = []
    order = np.argsort(shift, kind="stable")
    for near in np.split(order, np.flatnonzero(np.diff(shift[order]) > least // 4) + 1):
        opened = len(out)
        for k in near[np.argsort(first[near], kind="stable")].tolist():
            start, end, at = max(0, int(first[k]) - reach), int(last[k]) + least + reach, int(shift[k])
            if len(out) > opened and start <= out[-1][1]:
                out[-1][1:] = [max(out[-1][1], end), min(out[-1][2], at), max(out[-1][3], at)]
            else:
                out.append([start, end, at, at])
    return [tuple(x) for x in out]


def _rows(rows: list[tuple[int, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def _candidates(batches: Iterator[pa.RecordBatch], *, least: int, reach: int) -> Iterator[pa.RecordBatch]:
    for table, edges in groups.whole_runs(batches, ["a", "b"]):
        a, b, first, last, shift = (table[c].to_numpy().astype(np.int64) for c in ("a", "b", "first", "last", "shift"))
        rows = [(a[k], b[k], *found) for k, stop in zip(edges, edges[1:]) for found in candidates(first[k:stop], last[k:stop], shift[k:stop], least, reach)]
        yield _rows(rows, _CANDIDATE)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each item of a list column, and the items."""
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy()), column.flatten()


def _cuts(batches: Iterator[pa.RecordBatch], *, width: int) -> Iterator[pa.RecordBatch]:
    """The part of each text that its candidates need, from the first word of their first shingle to the last of their last."""
    names = [*_CANDIDATE, "side", "at", "words"]
    for batch in slices(batches):
        held, edges, starts, counts = word_starts(batch.column("text"))
        of, asked = _lists(batch.column("asked"))
        fields = dict(zip((f.name for f in asked.type), asked.flatten()))
        offset = np.cumsum(counts) - counts

        def bytes_before(word: np.ndarray) -> np.ndarray:
            past = word >= counts[of]
            return np.where(past, edges[of + 1], np.append(starts, 0)[np.where(past, 0, offset[of] + word)])

        low = bytes_before(fields["at"].to_numpy())
        high = np.maximum(low, bytes_before(fields["stop"].to_numpy() + width - 1))
        part = np.cumsum(high - low) // SLICE_BYTES
        for k in np.split(np.arange(len(of)), np.flatnonzero(np.diff(part)) + 1):
            here = pa.array([held[x:y].tobytes() for x, y in zip(low[k].tolist(), high[k].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(fields[c].slice(k[0], len(k)) for c in names[:-1]), here], names)


def matched(here: np.ndarray, there: np.ndarray, shift: float, slack: float) -> np.ndarray:
    """Whether each value has an equal one in `there` within `slack` of its own place less `shift`."""
    numbers = np.unique(np.concatenate([here, there]), return_inverse=True)[1].astype(np.uint64)
    here, there = numbers[: len(here)], numbers[len(here) :]
    return _matched(here, np.array([len(here)]), there, np.array([len(there)]), np.array([shift], dtype=np.float64), np.array([slack], dtype=np.float64))


def _placed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values of several sequences put together: where each sequence starts, the sequence of each value, and its place there."""
    offset = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    return offset, of, np.arange(len(of)) - offset[of]


def _matched(here: np.ndarray, here_lengths: np.ndarray, there: np.ndarray, there_lengths: np.ndarray, shift: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """`matched` for pairs of sequences, each side put together, with a shift and slack for each pair."""
    _, of, place = _placed(here_lengths)
    offset, there_of, there_place = _placed(there_lengths)
    out = np.zeros(len(here), dtype=bool)
    at = place - np.rint(shift).astype(np.int64)[of]
    inside = np.flatnonzero((at >= 0) & (at < there_lengths[of]))
    out[inside] = here[inside] == there[offset[of[inside]] + at[inside]]
    left = np.flatnonzero(~out)
    asked = np.zeros(len(shift), dtype=bool)
    asked[of[left]] = True
    held = np.flatnonzero(asked[there_of])
    if not len(held):
        return out
    salt = mixed(np.arange(1, len(shift) + 1, dtype=np.uint64) << np.uint64(32))
    keys = there[held] ^ salt[there_of[held]]
    order = np.argsort(keys, kind="stable")
    ordered, there_place = keys[order], there_place[held][order]
    rank = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    sought = here[left] ^ salt[of[left]]
    at = np.minimum(np.searchsorted(ordered, sought), len(ordered) - 1)
    known = ordered[at] == sought
    left, rank_of = left[known], rank[at[known]]
    # Equal values lie in the order of their places, so rank and place together rise.
    wanted = place[left] - shift[of[left]]
    span = float((there_lengths + here_lengths + np.abs(shift) + slack).max() + 1)
    after = np.searchsorted(3 * span * rank + there_place, 3 * span * rank_of + np.clip(wanted, -span, 2 * span))
    for k in (after, after - 1):
        inside = (k >= 0) & (k < len(ordered))
        k = np.where(inside, k, 0)
        out[left] |= inside & (rank[k] == rank_of) & (np.abs(there_place[k] - wanted) <= slack[of[left]])
    return out


def similar_spans(found: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """Spans (end exclusive) of `least` places or more whose Jaccard similarity with the other side reaches `similarity`.

    Of n places here and as many there, m in common are m / (2n - m). Runs of `least` places that
    reach it are put together where they overlap; neighbours are joined while the whole still reaches it.
    A span begins and ends with a place in common, unless it would be too short.
    """
    _, starts, ends = _similar_spans(found, np.array([len(found)]), least, similarity)
    return list(zip(starts.tolist(), ends.tolist()))


def _similar_spans(found: np.ndarray, lengths: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`similar_spans` of sequences put together: the sequence, start and end of each span."""
    total = np.concatenate([[0], np.cumsum(found)])
    enough = lambda m, n: m * (1 + similarity) >= 2 * similarity * n - 1e-9
    offset, of, _ = _placed(lengths)
    good = np.flatnonzero(enough(total[least:] - total[:-least], least)) if len(found) >= least else np.zeros(0, dtype=np.int64)
    good = good[of[good] == of[good + least - 1]]
    if not len(good):
        return good, good, good
    cut = np.flatnonzero((np.diff(good) >= least) | (of[good[1:]] != of[good[:-1]]))
    start, end = good[np.concatenate([[0], cut + 1])], good[np.concatenate([cut, [len(good) - 1]])] + least
    common = np.flatnonzero(found)
    low = np.minimum(common[np.searchsorted(common, start)], end - least)
    high = np.maximum(common[np.searchsorted(common, end) - 1] + 1, low + least)
    whose = of[start]
    if len(cut) and (whose[1:] == whose[:-1]).any():
        spans: list[list[int]] = []
        for owner, first, stop in zip(whose.tolist(), low.tolist(), high.tolist()):
            if spans and spans[-1][0] == owner and enough(total[stop] - total[spans[-1][1]], stop - spans[-1][1]):
                spans[-1][2] = max(stop, spans[-1][2])
            else:
                spans.append([owner, first, stop])
        whose, low, high = np.array(spans).T
    return whose, low - offset[whose], high - offset[whose]


_SPAN = ["doc", "partner", "start", "end"]


def _cut_grams(cuts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several cuts put together, and how many each has."""
    hashes, lengths = word_hashes(cuts.combine_chunks())
    if lengths.min() < width:
        each = [shingles(x, width) for x in np.split(hashes, np.cumsum(lengths)[:-1])]
        return np.concatenate(each), np.array([len(x) for x in each])
    grams = shingles(hashes, width)
    return grams[_run_starts(lengths, width)[0]], lengths - width + 1


def _confirm(batches: Iterator[pa.RecordBatch], *, width: int, least: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for table, edges in groups.whole_runs(batches, _CANDIDATE):
        a, b, low, high, at = (table[c].to_numpy() for c in ("a", "b", "low", "high", "at"))
        first, second = edges[:-1], edges[1:] - 1
        first, second = first[second > first], second[second > first]
        if not len(first):
            continue
        cuts, sizes = table["words"], pc.binary_length(table["words"]).to_numpy()
        part = np.cumsum(sizes[first] + sizes[second]) // _CONFIRM_BYTES
        for k in np.split(np.arange(len(first)), np.flatnonzero(np.diff(part)) + 1):
            i, j = first[k], second[k]
            (here, here_lengths), (there, there_lengths) = (_cut_grams(cuts.take(pa.array(x)), width) for x in (i, j))
            shift, slack = (low[i] + high[i]) / 2 - at[i] + at[j], (high[i] - low[i]) / 2 + least // 4
            of, start, end = _similar_spans(_matched(here, here_lengths, there, there_lengths, shift, slack), here_lengths, least, similarity)
            if not len(of):
                continue  # what the one side lacks, the other does not have in common either
            yield _spans(a[i][of], b[i][of], start + at[i][of], end + at[i][of] + width - 1)
            some = np.zeros(len(i), dtype=bool)
            some[of] = True
            some_here, some_there = (x[np.repeat(some, lengths)] for x, lengths in ((here, here_lengths), (there, there_lengths)))
            back = _matched(some_there, there_lengths[some], some_here, here_lengths[some], -shift[some], slack[some])
            of, start, end = _similar_spans(back, there_lengths[some], least, similarity)
            i, j = i[some], j[some]
            yield _spans(b[i][of], a[i][of], start + at[j][of], end + at[j][of] + width - 1)


def _spans(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _SPAN)


def _unconfirmed(sided: DataFrame, found: DataFrame, run_words: int) -> DataFrame:
    """Links whose stretches are not both inside confirmed spans of their two documents."""
    ours, span = F.col("doc") < F.col("partner"), F.struct("start", "end")
    spans = found.groupBy(F.least("doc", "partner").alias("a"), F.greatest("doc", "partner").alias("b"))
    spans = spans.agg(F.collect_list(F.when(ours, span)).alias("here"), F.collect_list(F.when(~ours, span)).alias("there"))
    inside = lambda side, shift: F.exists(side, lambda x: (x["start"] <= F.col("first") - shift) & (F.col("last") - shift + run_words <= x["end"]))
    known = F.coalesce(inside("here", F.lit(0)) & inside("there", F.col("shift")), F.lit(False))
    return sided.join(spans, ["a", "b"], "left").where(~known).drop("here", "there")


def _verified(texts: DataFrame, links: DataFrame, *, width: int, least: int, similarity: float, known: DataFrame | None = None, reach: int | None = None) -> Table:
    """Confirmed spans (doc, partner, start, end in words) of links, for both sides; links inside the spans `known` already give none.

    Words are read `reach` places before and after the links' runs, a run if it is not given.
    """
    ours = F.col("doc") < F.col("partner")
    pick = lambda mine, other: F.when(ours, F.col(mine)).otherwise(F.col(other))
    mine, other = _unpacked("at"), _unpacked("other_at")
    here = {c: F.when(ours, mine[c]).otherwise(other[c]) for c in ("first", "last")}
    shift = F.when(ours, mine["place"] - other["place"]).otherwise(other["place"] - mine["place"])
    sided = links.select(pick("doc", "partner").alias("a"), pick("partner", "doc").alias("b"), here["first"].alias("first"), here["last"].alias("last"), shift.alias("shift"))
    if known is not None:
        sided = _unconfirmed(sided, known, least + width - 1)
    sided = sided.groupBy("a", "b", "first", "shift").agg(F.max("last").alias("last"))
    dealt = sided.repartition("a", "b").sortWithinPartitions("a", "b")
    pairs = Table(dealt.mapInArrow(partial(_candidates, least=least, reach=reach or least), ", ".join(f"{c} long" for c in _CANDIDATE)), "candidates")
    slack = F.lit(least // 4)
    side = lambda owner, number, at, stop: F.struct(F.col(owner).alias("owner"), F.lit(number).alias("side"), at.alias("at"), stop.alias("stop"))
    sides = F.array(side("a", 0, F.col("start"), F.col("end")), side("b", 1, F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("high") - slack), F.col("end") - F.col("low") + slack))
    asked = pairs.df.select(*_CANDIDATE, F.explode(sides).alias("s")).groupBy(F.col("s.owner").alias("doc"))
    asked = asked.agg(F.collect_list(F.struct(*_CANDIDATE, "s.side", "s.at", "s.stop")).alias("asked"))
    fetched = texts.select("doc", "text").join(asked, "doc").select("text", "asked")
    cut = fetched.mapInArrow(partial(_cuts, width=width), ", ".join(f"{c} long" for c in _CANDIDATE) + ", side int, at long, words binary")
    dealt = cut.repartition("a", "b", "start").sortWithinPartitions(*_CANDIDATE, "side")
    found = Table(dealt.mapInArrow(partial(_confirm, width=width, least=least, similarity=similarity), "doc long, partner long, start long, end long").distinct(), "passages")
    pairs.drop()
    return found


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _exact_runs(batches: Iterator[pa.RecordBatch], *, width: int, least: int) -> Iterator[pa.RecordBatch]:
    """The key of every run that a text's stretches (list at) hold."""
    for batch in slices(batches):
        hashes, counts = word_hashes(batch.column("text"))
        grams, offset = shingles(hashes, width), np.cumsum(counts) - counts
        of, at = _lists(batch.column("at"))
        at = at.to_numpy()
        first = offset[of] + (at >> _FIRST_BITS)
        last = first + ((at & ((1 << _FIRST_BITS) - 1)) >> _LAST_BITS)
        wanted = np.bincount(first, minlength=len(hashes) + 1) - np.bincount(last + 1, minlength=len(hashes) + 1)
        starts = np.flatnonzero(np.cumsum(wanted) > 0)
        # A polynomial of the run's shingles: the difference of two running sums, each term scaled back by its place.
        scale, back = (np.multiply.accumulate(np.full(len(grams) + 1, x, dtype=np.uint64)) for x in (_BASE, _INVERSE))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(grams * back[:-1], dtype=np.uint64)])
        keys = mixed((total[starts + least] - total[starts]) * scale[starts]).view(np.int64)
        of = np.searchsorted(offset, starts, "right") - 1
        places = starts - offset[of]
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc").take(pa.array(of)), pa.array(_packed(places, places, places))], _ROW)


def _disputed(links: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Per text the stretches (asked: group, at) of the groups of two links or more that have one no confirmed span covers."""
    spans = found.groupBy("doc", "partner").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    place = _unpacked("at")["place"]
    covered = F.exists(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")), lambda x: (place >= x["start"]) & (place + width <= x["end"]))
    links = links.withColumn("group", F.shiftright("key", 16))
    judged = links.join(spans, ["doc", "partner"], "left").select("group", covered.alias("covered"))
    open_groups = judged.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("covered").alias("settled")).where("n > 1 AND NOT settled").select("group")
    sides = F.array(F.struct("doc", "at"), F.struct(F.col("partner").alias("doc"), F.col("other_at").alias("at")))
    members = links.select("group", F.explode(sides).alias("s")).select("group", "s.*").join(open_groups, "group", "left_semi").distinct()
    return members.groupBy("doc").agg(F.collect_list(F.struct("group", "at")).alias("asked"))


def _surroundings(batches: Iterator[pa.RecordBatch], *, width: int, least: int) -> Iterator[pa.RecordBatch]:
    """32 bits of each shingle from `reach` before a stretch's minimum to `reach` after it, 0 beyond the text."""
    reach = least + least // 4
    for batch in slices(batches):
        hashes, counts = word_hashes(batch.column("text"))
        grams = (shingles(hashes, width) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        starts, owner, _ = _run_starts(counts, width)
        padded = np.zeros(len(hashes) + reach * (len(counts) + 1), dtype=np.uint32)
        padded[starts + reach * (owner + 1)] = grams[starts]
        of, asked = _lists(batch.column("asked"))
        group, at = asked.flatten()
        docs, packed = batch.column("doc").take(pa.array(of)), at.to_numpy()
        place = (np.cumsum(counts) - counts + reach * np.arange(len(counts)))[of] + (packed >> _FIRST_BITS) + (packed & ((1 << _LAST_BITS) - 1))
        for low in range(0, len(at), 1 << 11):
            around = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)[place[low : low + (1 << 11)]])
            cuts = pa.py_buffer((np.arange(len(around) + 1) * around.itemsize * around.shape[1]).astype(np.int32))
            found = pa.Array.from_buffers(pa.binary(), len(around), [None, cuts, pa.py_buffer(around)])
            yield pa.RecordBatch.from_arrays([*(x.slice(low, len(around)) for x in (group, docs, at)), found], ["group", "doc", "at", "grams"])


def _dense(common: np.ndarray, least: int, needed: int) -> np.ndarray:
    """Which rows have `needed` places in some run of `least`."""
    out = np.add.reduce(common, axis=1, dtype=np.int16) >= needed
    if out.any():
        total = np.add.accumulate(common[out].T.astype(np.int16), axis=0)
        out[out] = (total[least - 1] >= needed) | (total[least:] - total[:-least] >= needed).any(axis=0)
    return out


def meeting(grams: np.ndarray, docs: np.ndarray, least: int, needed: int) -> list[tuple[int, int]]:
    """Pairs of rows, of different documents, that may have `needed` of `least` places in common and are not linked by other pairs that surely have.

    A row without so many values in a run that any other row has is out; the rest are compared with all rows of other classes.
    """
    values, grams = np.unique(grams, return_inverse=True)
    grams = grams.reshape(len(docs), -1).astype(np.int32)  # numbers of the values
    held = np.sort(grams, axis=1)
    once = np.concatenate([np.ones((len(held), 1), dtype=bool), held[:, 1:] != held[:, :-1]], axis=1)
    beyond = bool(len(values)) and values[0] == 0
    alive = np.arange(len(grams))
    while len(alive) > 1:
        counts = np.bincount(held[alive][once[alive]], minlength=len(values))
        if beyond:
            counts[0] = 0
        keep = _dense((counts > 1)[grams[alive]], least, needed)
        if keep.all():
            break
        alive = alive[keep]
    if len(alive) < 2:
        return []
    grams, docs, out = grams[alive], docs[alive], []
    if beyond:
        grams[grams == 0] = -1  # the last of `has`, which is never set
    has, classes = np.zeros(len(values) + 1, dtype=bool), np.arange(len(alive))
    known = grams >= 0
    for row in range(len(alive)):
        others = classes != classes[row]
        if not others.any():
            break
        others = np.flatnonzero(others & (docs != docs[row]))
        sure = _dense((grams[others] == grams[row]) & known[row], least, needed)
        joined = np.zeros(len(alive), dtype=bool)
        if sure.any():
            met = others[sure]
            of, first = np.unique(classes[met], return_index=True)
            out += [(row, k) for k in met[first].tolist()]
            joined[of] = True
        rest = others[~sure & (others > row)]
        rest = rest[~joined[classes[rest]]]
        if len(rest):
            has[grams[row]] = True
            has[-1] = False
            out += [(row, k) for k in rest[_dense(has[grams[rest]], least, needed)].tolist()]
            has[grams[row]] = False
        classes[joined[classes]] = classes[row]
    return [(int(alive[a]), int(alive[b])) for a, b in out]


def _meetings(batches: Iterator[pa.RecordBatch], *, least: int, similarity: float) -> Iterator[pa.RecordBatch]:
    needed, size = int(np.ceil(2 * similarity * least / (1 + similarity) - 1e-9)), 2 * (least + least // 4) + 1
    for table, edges in groups.whole_runs(batches, ["group"]):
        doc, at = (table[c].to_numpy() for c in ("doc", "at"))
        grams, rows = np.frombuffer(b"".join(table["grams"].to_pylist()), dtype=np.uint32).reshape(-1, size), []
        for k, stop in zip(edges.tolist(), edges[1:].tolist()):
            rows += [(doc[k + i], at[k + i], doc[k + j], at[k + j]) for i, j in meeting(grams[k:stop], doc[k:stop], least, needed)]
        if rows:
            yield _rows(rows, ["doc", "at", "partner", "other_at"])


def repeated_passages(docs: DataFrame, *, width: int = 5, min_words: int = 50, functions: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row for each confirmed passage and document it was confirmed with: doc_id, partner_id, class_id, start, end.

    start and end (exclusive) count the words of the whole text of doc_id; a passage has
    `min_words` words or more, and its Jaccard similarity with a passage of partner_id, on shingles of `width`
    words, is at least `similarity`. Of a group with one passage each is confirmed with neighbours, not with all.
    Documents linked by passages, directly or through others, share class_id, the least doc_id among them.
    Of equal texts the least doc_id has the passages; each other one has a row of its whole text with it.

    Defined cases: null, empty and shorter texts have no passages; rows that agree in
    doc_id and text are one document, which is not its own partner; a null doc_id is kept, and
    names a class or stands for equal texts only if none of them has an id;
    a passage repeated inside one document only is not reported; an empty
    table gives an empty table; other columns are not read.
    """
    spark, least = docs.sparkSession, max(1, min_words - width + 1)
    known = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.md5("text")).alias("doc"))
    missing = F.col("doc_id").isNull()
    equal = known.groupBy("doc").agg(F.first("text").alias("text"), F.min("doc_id").alias("rep_id"), F.max("doc_id").alias("other_id"), (F.max(missing) & ~F.min(missing)).alias("some_missing"))
    n_ids = F.when(F.col("some_missing") | (F.col("rep_id") < F.col("other_id")), 2).otherwise(1)
    texts = Bucketed(equal.withColumn("n_ids", n_ids).drop("some_missing"), "texts", "doc", buckets(spark))  # joined three times
    release(spark)
    number = len(ring(functions))
    schema = "doc long, " + ", ".join(f"key{k} array<long>, at{k} array<long>" for k in range(number))
    windows = Table(texts.df.select("doc", "text").mapInArrow(partial(_windows, width=width, least=least, functions=functions), schema), "windows")
    links: list[tuple[Table, DataFrame]] = []
    for k in range(number):
        zipped = F.arrays_zip(F.col(f"key{k}").alias("key"), F.col(f"at{k}").alias("at"))
        links.append(_linked(windows.df.select("doc", F.inline(zipped))))
        release(spark)
    windows.drop()
    every = reduce(DataFrame.unionAll, [part for table, ends in links for part in (table.df.where("kind = 0"), ends)])
    near = _verified(texts.df, every, width=width, least=least, similarity=similarity)
    release(spark)
    table, ends = links[0]
    asked = texts.df.select("doc", "text").join(_grouped_stretches(table.df.unionAll(ends)), "doc")
    runs = Table(asked.mapInArrow(partial(_exact_runs, width=width, least=least), "key long, doc long, at long"), "runs")
    same, ends = _linked(runs.df)
    release(spark)
    exact = _verified(texts.df, same.df.where("kind = 0").unionAll(ends), width=width, least=least, similarity=similarity, known=near.df)
    release(spark)
    both = near.df.unionAll(exact.df)
    asked = texts.df.select("doc", "text").join(_disputed(every, near.df, width), "doc")
    around = asked.mapInArrow(partial(_surroundings, width=width, least=least), "group long, doc long, at long, grams binary")
    met = Table(around.repartition("group").sortWithinPartitions("group").mapInArrow(partial(_meetings, least=least, similarity=similarity), "doc long, at long, partner long, other_at long"), "met")
    others = _verified(texts.df, met.df, width=width, least=least, similarity=similarity, known=both, reach=least + least // 4)  # as far as meetings look
    found = Table(both.unionAll(others.df).distinct(), "passages").df
    for table in (*(table for table, _ in links), near, runs, same, exact, met, others):
        table.drop()
    release(spark)
    return _of_documents(known, texts.bare, found, min_words=min_words)


def _grouped_stretches(links: DataFrame) -> DataFrame:
    """Lists (at) of the stretches of each text that share their key with another's, and of a few that do not."""
    here, there = F.struct("doc", "at"), F.struct(F.col("partner").alias("doc"), F.col("other_at").alias("at"))
    sides = links.select(F.explode(F.array(here, there)).alias("s")).select("s.*").where("doc IS NOT NULL")
    return sides.groupBy("doc").agg(F.collect_set("at").alias("at"))


def _of_documents(known: DataFrame, texts: DataFrame, found: DataFrame, *, min_words: int) -> DataFrame:
    """Spans of texts as rows of documents: those of a text for its least id, and one of the whole text for each of its copies."""
    linked = components(found.select(F.col("doc").alias("a"), F.col("partner").alias("b")))
    ids = texts.select("doc", "rep_id", "other_id", "n_ids").join(linked, F.col("doc") == F.col("node"), "left").where("n_ids > 1 OR node IS NOT NULL")
    placed = Table(ids.select("doc", "rep_id", "other_id", "n_ids", F.coalesce("component", "doc").alias("component")), "placed").df
    named = Table(placed.groupBy("component").agg(F.min("rep_id").alias("class_id")), "named").df
    placed = Table(placed.join(named, "component").drop("component"), "placed").df
    partners = placed.select(F.col("doc").alias("partner"), F.col("rep_id").alias("partner_id"))
    spans = found.join(placed, "doc").join(partners, "partner").select(F.col("rep_id").alias("doc_id"), "partner_id", "class_id", "start", "end")
    lengths = texts.where("n_ids > 1").select("doc", "text").mapInArrow(_lengths, "doc long, n_words long").where(F.col("n_words") >= min_words)
    copied = Table(placed.where("n_ids > 1").join(lengths, "doc"), "copied").df  # read bare, so that adaptive execution can split the copies of one text
    other = F.when(~F.col("doc_id").eqNullSafe(F.col("rep_id")), F.col("rep_id")).when(F.col("rep_id") < F.col("other_id"), F.col("other_id"))
    copies = known.select("doc_id", "doc").distinct().join(copied, "doc").select("doc_id", other.alias("partner_id"), "class_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    return spans.unionAll(copies)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(word_starts(batch.column("text"))[3])], ["doc", "n_words"])
