"""Exact repeats of long byte strings, by suffix arrays over anchored segments.

Every window of WINDOW bytes has an anchor value: the least hash of its short
substrings.  Equal windows have equal anchors, so the windows of one anchor
value, which come as short segments of text, can be judged apart from all
others.  Segments whose anchor is met once, at one place, hold no repeat.  The
bytes of all others come together by anchor.  Cut into pieces of PIECE bytes,
counted from the anchor, each segment is a short string of symbols, and a suffix
array (linear grouping construction) puts equal runs of pieces side by side:
windows inside such a run are repeats.  Windows that end in a piece which
differs are left; they are cut into blocks of BLOCK windows that share a core,
each written as its outer bytes around one symbol for the core, and a second
suffix array over these settles them.  Hashes only say where segments meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packed import ENTRIES, FOUND, LAST_ID, bucket_bits, by_document, entries, entry_rows, found_rows, groups, keyed, pack, passed, steps, unpack
from .suffix_array import suffix_array

WINDOW = 200
#: Bytes of the substrings whose least hash is the anchor.
GRAIN = 48
#: Windows in a block.
BLOCK = 8
#: Bytes of a piece, which is one symbol of a suffix array.
PIECE = 32
#: Different segments of one anchor, in a slice and in a bucket, beyond which those that differ are counted by window instead: a hot anchor's windows go to many buckets.
SLICE_SEGMENTS, BUCKET_SEGMENTS = 64, 4096
#: Equal segments in one suffix array, and blocks of one core.
EQUAL_SEGMENTS, ARRAY_BLOCKS = 256, 8192
#: Segments, by whole groups, whose fringes are handled at a time.
FRINGE_SEGMENTS = 2048
#: Symbols in one suffix array, unless one core has more.
ARRAY_SYMBOLS = 40_000
#: Windows in one segment; longer ones (of periodic text) are cut, which loses no window.
SEGMENT_WINDOWS = 2048

COVERED, COMPARED, COUNTED = 0, 1, 2


def anchors(data: np.ndarray, window: int = WINDOW, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """By where a window starts: its anchor, and where the first substring with that hash starts."""
    hashes = common.Rolling(common.BYTE_VALUES[data]).windows(grain, light=True)
    span = window - grain + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Least of each span of hashes: prefix minima of blocks meet suffix minima.  The low bits hold the place.
    low = np.uint64((1 << 24) - 1)
    size = -(-len(hashes) // span) * span
    blocks = np.full(size, np.uint64(2**64 - 1))
    blocks[: len(hashes)] = (hashes & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
    start = np.arange(n)
    at = start + (((least & low).astype(np.int64) - start) & int(low))
    return hashes[at], at


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document, first window and number of windows of each segment, whether windows in it may be equal, and the anchor's distance."""
    a, found = anchors(data, window)
    n = len(a)
    if not n:
        return a, *(np.zeros(0, np.int64),) * 5
    size = np.maximum(np.diff(offsets) - window + 1, 0)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offsets[:-1][size > 0], 1)
    np.add.at(valid, (offsets[:-1] + size)[size > 0], -1)
    valid = np.cumsum(valid[:n]) > 0
    change = np.ones(n, bool)
    change[1:] = a[1:] != a[:-1]
    change |= ~valid
    change[offsets[:-1][(size > 0)]] = True
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, n))
    keep = valid[start]
    start, count = start[keep], count[keep]
    # Equal windows in a segment have the anchor at two places.
    loose = found[start] != found[start + count - 1]
    if len(count) and count.max() > SEGMENT_WINDOWS:
        parts = -(-count // SEGMENT_WINDOWS)
        of = np.repeat(np.arange(len(count)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count, loose = start[of] + nth * SEGMENT_WINDOWS, np.minimum(SEGMENT_WINDOWS, count[of] - nth * SEGMENT_WINDOWS), loose[of]
    return a[start], np.searchsorted(offsets, start, "right") - 1, start, count, loose, found[start] - start


def _buckets(bits: int, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Entries by the high bits of their keys, in their order."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _by_bucket(bits: int, key: np.ndarray, did: np.ndarray, th: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Entries packed by the high bits of ``key``, with the ids of their documents; ``doc`` ascends."""
    for b, at in _buckets(bits, key):
        docs, place = np.unique(doc[at], return_inverse=True)
        yield b, pack(did[docs].astype(np.uint64), th[docs].astype(np.uint64), steps(place), *(c[at] for c in columns))


def _entries(table: pa.Table, columns: int | None = None) -> tuple[np.ndarray, ...] | None:
    """did, th, doc and the columns of all packed entries of a bucket, or of those with so many columns."""
    parts = [p for p in entries(table) if columns is None or len(p) == columns]
    if not parts:
        return None
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    did, th = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
    doc = np.concatenate([np.cumsum(p[2].astype(np.int64)) + s for p, s in zip(parts, shift[:-1], strict=True)])
    return did, th, doc, *(np.concatenate([p[k] for p in parts]) for k in range(3, len(parts[0])))


def _firsts(code: np.ndarray) -> np.ndarray:
    """Which entries are the first of their code."""
    first = np.zeros(len(code), bool)
    first[np.unique(code, return_index=True)[1]] = True
    return first


def _runs(flags: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flags of the windows of segments after one another: each run's segment, first window in it, and length."""
    edges = np.concatenate(([0], np.cumsum(count)))
    starts = np.zeros(len(flags) + 1, bool)
    starts[edges] = True
    on = np.flatnonzero(flags & np.concatenate(([True], ~flags[:-1] | starts[1 : len(flags)])))
    off = np.flatnonzero(flags & np.concatenate((~flags[1:] | starts[1 : len(flags)], [True]))) + 1
    of = np.searchsorted(edges, on, "right") - 1
    return of, on - edges[of], off - on


def _scan(bits: int, window: int):
    """Documents to packed segments by bucket; repeats within a slice are settled on the spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.utf8(batch.column("text"))
            did, th = (batch.column(k).to_numpy().astype(np.int64) for k in ("did", "th"))
            anchor, doc, start, count, loose, lead = segments(data, offsets, window)
            if not len(anchor):
                continue
            content = common.Rolling(common.BYTE_VALUES[data], common.BASES[1]).ranges(start, start + count + window - 1) + count.astype(np.uint64)
            code, n = groups(common.mix(anchor) ^ content)
            repeated = (np.bincount(code, minlength=n) > 1)[code]
            first = _firsts(code)
            by_anchor, m = groups(anchor)
            hot = (np.bincount(by_anchor[first], minlength=m) > SLICE_SEGMENTS)[by_anchor]
            within = start - offsets[doc]
            r = np.flatnonzero(repeated)
            flags = shared_windows(data, start[r], count[r], lead[r], code[r], code[r], window)
            of, x, length = _runs(flags, count[r])
            found = found_rows(bits, did, th, doc[r[of]], np.full(len(of), COVERED), within[r[of]] + x, length)
            # An anchor with many segments in this slice: their windows are counted, and the bucket hears of it once.
            many = hot & first
            found += found_rows(bits, did, th, doc[many], np.full(many.sum(), COUNTED), within[many], count[many], lead[many], repeated[many].astype(np.int64))
            flags = repeated + 2 * loose + 4 * hot
            sent = _by_bucket(bits, common.mix(anchor[first]), did, th, doc[first], within[first], count[first], lead[first], anchor[first], content[first], flags[first])
            yield entry_rows(bits, found, [*sent])

    return run


def _judge(bits: int):
    """One bucket: which segments are compared as they are, and which are counted by window."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if got := _entries(table):
            did, th, doc, within, count, lead, anchor, content, flags = got
            known, loose, hot = ((flags & np.uint64(k)) > 0 for k in (1, 2, 4))
            by_anchor, n = groups(anchor)
            code, m = groups(common.mix(anchor) ^ content)
            first = _firsts(code)
            some = lambda x: (np.bincount(by_anchor, weights=x, minlength=n) > 0)[by_anchor]
            different = np.bincount(by_anchor[first], minlength=n)[by_anchor]
            any_hot = some(hot) | (different > BUCKET_SEGMENTS)
            apart = any_hot | some(loose)
            equal = np.bincount(code, minlength=m)[code] > 1
            # Whoever is known has an equal one in its slice and only bears witness, once.
            met = np.where(apart, equal, np.bincount(by_anchor, minlength=n)[by_anchor] > 1)
            open_ones = (np.bincount(code, weights=~known, minlength=m) > 0)[code] | (~apart & some(~known))
            witness = np.zeros(len(code), bool)
            k = np.flatnonzero(known)
            witness[k[np.unique(code[k], return_index=True)[1]]] = True
            send = met & open_ones & (~known | witness)
            kind = np.where(apart, COMPARED + 2, COMPARED)
            rows += found_rows(bits, did, th, doc[send], kind[send], within[send], count[send], lead[send], known[send].astype(np.int64))
            single = first & ~hot & apart & ((different > 1) | (loose & ~(known | equal)) | any_hot)
            rows += found_rows(bits, did, th, doc[single], np.full(single.sum(), COUNTED), within[single], count[single], lead[single], (known | equal)[single].astype(np.int64))
        return passed(table, rows)

    return run


def _pieces(start: np.ndarray, count: np.ndarray, lead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and segment of each piece; pieces begin at multiples of PIECE from the anchor, a segment's first and last may be shorter."""
    size = count + window - 1
    head = lead % PIECE
    number = (head > 0) + -(-(size - head) // PIECE)
    nth, of = _spread(np.zeros(len(start), np.int64), number)
    begin = np.maximum(start[of] + head[of] + (nth - (head > 0)[of]) * PIECE, start[of])
    end = np.minimum(start[of] + head[of] + (nth + 1 - (head > 0)[of]) * PIECE, (start + size)[of])
    return begin, end - begin, of


def _symbols(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers from 1 that are equal for pieces of equal bytes only."""
    where = begin[:, None] + np.arange(PIECE)
    raw = np.where(np.arange(PIECE) < length[:, None], data[np.minimum(where, len(data) - 1)], 0).astype(np.uint8)
    words = raw.view(np.uint64)
    key = length.astype(np.uint64)
    for k in range(words.shape[1]):
        key = common.mix(key + words[:, k])
    code, n = groups(key)
    first = np.zeros(n, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    if (words[first[code]] != words).any() or (length[first[code]] != length).any():
        code = np.unique(np.column_stack([words, length.astype(np.uint64)]), axis=0, return_inverse=True)[1].ravel()
    return code + 1


def _in_arrays(symbols: np.ndarray, length: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of pieces of segments after one another: how many bytes from each piece on another suffix shares with it, by one suffix array."""
    last = np.append(of[1:] != of[:-1], True)
    at = np.arange(len(symbols)) + np.cumsum(last) - last  # a zero follows each segment
    text = np.zeros(len(symbols) + int(last.sum()), np.int64)
    text[at] = symbols
    sizes = np.zeros(len(text), np.int64)
    sizes[at] = length
    order = np.array(suffix_array(text.tolist()), np.int64)
    shared = np.zeros(len(text), np.int64)
    pair = np.flatnonzero((text[order[1:]] > 0) & (text[order[1:]] == text[order[:-1]]))
    run = np.zeros(len(order), np.int64)
    k = 0
    while len(pair):
        run[pair + 1] += sizes[order[pair + 1] + k]
        k += 1
        a, b = order[pair] + k, order[pair + 1] + k
        inside = np.maximum(a, b) < len(text)
        pair, a, b = pair[inside], a[inside], b[inside]
        pair = pair[(text[a] > 0) & (text[a] == text[b])]
    shared[order] = np.maximum(run, np.append(run[1:], 0))
    return shared[at]


def shared_windows(data: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, group: np.ndarray, equal: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which windows of segments, one after another, are found elsewhere in segments of the same ``group``.

    Segments of a group lie around one anchor, ``lead`` bytes behind their
    starts; ``equal`` says which are likely the same, so that many of them are
    compared by EQUAL_SEGMENTS, each time with the first.
    """
    total = int(count.sum())
    flags = np.zeros(total, bool)
    if not len(start):
        return flags
    order = np.lexsort((equal, group))
    e = equal[order]
    head = np.concatenate(([True], e[1:] != e[:-1]))
    rank = np.arange(len(order)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    turn = rank // EQUAL_SEGMENTS
    again = np.flatnonzero((turn > 0) & (rank % EQUAL_SEGMENTS == 0))
    # The first of its kind joins each later turn.
    who = np.concatenate((order, order[again - rank[again]]))
    key = np.concatenate((group[order], group[order[again]])), np.concatenate((turn, turn[again]))
    by = np.lexsort((key[0], key[1]))
    who, turn, grouped = who[by], key[1][by], key[0][by]
    fresh = np.concatenate(([True], (turn[1:] != turn[:-1]) | (grouped[1:] != grouped[:-1])))
    weight = np.cumsum((count[who] + window) // PIECE + 3)
    starts = np.flatnonzero(fresh)
    chunk = (weight[starts] - weight[0]) // ARRAY_SYMBOLS
    edges = np.append(starts[np.concatenate(([True], chunk[1:] != chunk[:-1]))], len(who))
    first_flag = np.cumsum(count) - count
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = who[a:b]
        begin, length, of = _pieces(start[some], count[some], lead[some], window)
        run = _in_arrays(_symbols(data, begin, length), length, of)
        n = np.minimum(length, run - window + 1)
        hit = np.flatnonzero(n > 0)
        at, _ = _spread((first_flag[some[of[hit]]] + begin[hit] - start[some[of[hit]]]), n[hit])
        flags[at] = True
    _fringes(data, start, count, lead, group, window, flags)
    return flags


def _fringes(data: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, group: np.ndarray, window: int, flags: np.ndarray) -> None:
    """Adds to ``flags`` the windows whose first or last piece differs though the window is equal, by suffix arrays over blocks."""
    edges = np.concatenate(([0], np.cumsum(count)))
    sums = np.concatenate(([0], np.cumsum(~flags)))
    left = sums[edges[1:]] > sums[edges[:-1]]
    code, n = groups(group)
    some = np.flatnonzero((np.bincount(code, weights=left, minlength=n) > 0)[code])
    some = some[np.argsort(code[some], kind="stable")]
    # Whole groups of about FRINGE_SEGMENTS at a time, which bounds the memory.
    fresh = np.flatnonzero(np.concatenate(([True], code[some][1:] != code[some][:-1]))) if len(some) else some
    part = fresh // FRINGE_SEGMENTS
    cuts = np.append(fresh[np.concatenate(([True], part[1:] != part[:-1]))], len(some)) if len(some) else some
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = some[a:b]
        size = count[own] + window - 1
        raw = data[_spread(start[own], size)[0]]
        first = np.cumsum(size) - size
        at, of, mask, key, outer_left, outer_right = _blocks(raw, np.column_stack([first, first + size]), first, count[own], lead[own], window)
        core, n = groups(key ^ common.mix(code[own][of].astype(np.uint64) + np.uint64(7)))
        windows, block = _windows(at, mask)
        place = edges[own[of[block]]] + windows - first[of[block]]
        undecided = np.bincount(core[block[~flags[place]]], minlength=n) > 0
        take = np.flatnonzero(((np.bincount(core, minlength=n) > 1) & undecided)[core])
        take = take[np.argsort(core[take], kind="stable")]
        found = _by_arrays(core[take], mask[take], outer_left[take], outer_right[take])
        windows, block = _windows(at[take], found)
        of = of[take[block]]
        flags[edges[own[of]] + windows - first[of]] = True


def _by_arrays(core: np.ndarray, mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``repeated_blocks`` of blocks in the order of their cores, in arrays of about ARRAY_SYMBOLS."""
    found = np.zeros(len(core), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], core[1:] != core[:-1]))) if len(core) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(core)))
    chunk = starts * 2 * BLOCK // ARRAY_SYMBOLS
    chunk = np.where(sizes > ARRAY_BLOCKS, -1 - np.arange(len(starts)), chunk)
    edges = np.append(starts[np.concatenate(([True], chunk[1:] != chunk[:-1]))], len(core)) if len(starts) else starts
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        judge = _counted_blocks if b - a > ARRAY_BLOCKS and core[a] == core[b - 1] else repeated_blocks
        found[a:b] = judge(np.unique(core[a:b], return_inverse=True)[1], mask[a:b], left[a:b], right[a:b])
    return found


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of ranges, and the range of each."""
    of = np.repeat(np.arange(len(start)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count - start, count), of


def _cut_out(bits: int, window: int):
    """Documents with what was found in them: covered ranges pass, the bytes of segments and the hashes of windows go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.utf8(batch.column("text"))
            did, th = (batch.column(k).to_numpy().astype(np.int64) for k in ("did", "th"))
            plain_doc, plain_at, plain_count = [], [], []
            wanted: list[np.ndarray] = []
            for i, parts in enumerate(batch.column("parts")):
                for part in parts.values or ():
                    kind, within, count, *more = (x.astype(np.int64) for x in unpack(part.as_py()))
                    plain = kind == COVERED
                    plain_doc.append(np.full(plain.sum(), i))
                    plain_at.append(within[plain])
                    plain_count.append(count[plain])
                    if not plain.all():
                        lead, known = more
                        wanted.append(np.column_stack([np.full(len(kind), i), kind, within, count, lead, known])[~plain])
            found = found_rows(bits, did, th, *map(np.concatenate, (plain_doc, plain_at, plain_count))) if plain_doc else []
            sent: list[tuple[int, bytes]] = []
            if wanted:
                values = common.BYTE_VALUES[data]
                roll = common.Rolling(values, common.BASES[2])
                every = np.concatenate(wanted)
                doc, kind, within, count, lead, known = every[np.lexsort((every[:, 2], every[:, 0]))].T
                start = within + offsets[doc]
                k = np.flatnonzero(kind != COUNTED)
                if len(k):
                    size = count[k] + window - 1
                    content = common.Rolling(values, common.BASES[1]).ranges(start[k], start[k] + size) + count[k].astype(np.uint64)
                    key = roll.ranges((start + lead)[k], (start + lead)[k] + GRAIN)
                    # The anchor of very many segments, or of periodic ones: only equal ones meet.
                    key = np.where(kind[k] == COMPARED, key, key ^ common.mix(content))
                    for bucket, at in _buckets(bits, key):
                        docs, place = np.unique(doc[k[at]], return_inverse=True)
                        raw = data[_spread(start[k[at]], size[at])[0]]
                        sent.append((bucket, pack(did[docs].astype(np.uint64), th[docs].astype(np.uint64), steps(place), within[k[at]], count[k[at]], lead[k[at]], key[at], content[at], known[k[at]], raw)))
                k = np.flatnonzero(kind == COUNTED)
                if len(k):
                    at, of = _spread(start[k], count[k])
                    key = roll.ranges(at, at + window)
                    d, is_known = doc[k][of], known[k][of] > 0
                    code, n = groups(key)
                    repeated = (np.bincount(code, minlength=n) > 1)[code]
                    settled = repeated & ~is_known
                    found += found_rows(bits, did, th, d[settled], at[settled] - offsets[d[settled]], np.ones(settled.sum(), np.int64))
                    # The one that is sent stands for all of its kind, so a known one comes first.
                    order = np.lexsort((~is_known, code))
                    send = np.sort(order[np.concatenate(([True], code[order][1:] != code[order][:-1]))])
                    sent += _by_bucket(bits, key[send], did, th, d[send], at[send] - offsets[d[send]], key[send], (repeated | is_known)[send].astype(np.int64))
            yield entry_rows(bits, found, sent)

    return run


def _windows(at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose bits are set in blocks that start at ``at``, and the block of each."""
    of, j = np.nonzero((mask[:, None].astype(np.int64) >> np.arange(BLOCK)) & 1)
    return at[of].astype(np.int64) + j, of


def _blocks(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Blocks of segments: where each starts (maybe before its segment), its segment, windows, core and outer bytes; ``bounds`` are the segments' bytes."""
    # Window x of a segment is lead - (x - start) before the anchor; BLOCK of these distances make a block.
    high, low = lead // BLOCK, (lead - count + 1) // BLOCK
    number, of = _spread(low, high - low + 1)
    last = (start + lead)[of] - number * BLOCK  # the block's last window
    at = last - BLOCK + 1
    j = np.arange(BLOCK)
    x = at[:, None] + j
    valid = (x >= start[of][:, None]) & (x < (start + count)[of][:, None])
    mask = (valid * (1 << j)).sum(1)
    # Without a window in a segment's block, its core may lie outside the segment.
    inside = mask > 0
    at, of, mask, number, last = (x[inside] for x in (at, of, mask, number, last))
    core = common.Rolling(common.BYTE_VALUES[data], common.BASES[2]).ranges(last, at + window) ^ common.mix(number.astype(np.uint64) + np.uint64(1))
    begin, end = bounds[of].T

    def outer(first: np.ndarray) -> np.ndarray:
        where = first[:, None] + np.arange(BLOCK - 1)
        inside = (where >= begin[:, None]) & (where < end[:, None])
        values = np.where(inside, data[np.clip(where, 0, len(data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        return (values << (np.uint64(9) * np.arange(BLOCK - 1, dtype=np.uint64))).sum(1, dtype=np.uint64)

    left, right = outer(at), outer(at + window)
    return at, of, mask, core, left, right


def _unfold(outer: np.ndarray) -> np.ndarray:
    return ((outer[:, None] >> (np.uint64(9) * np.arange(BLOCK - 1, dtype=np.uint64))) & np.uint64(511)).astype(np.int64)


def repeated_blocks(core: np.ndarray, mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of different blocks, ``core`` numbered from 0: the windows (as bits) that another one has too, by one suffix array.

    A block is its outer bytes around one symbol for its core, so a window is
    BLOCK symbols that contain the core's.
    """
    n, width = len(core), 2 * BLOCK
    text = np.zeros((n, width), np.int64)
    text[:, : BLOCK - 1] = _unfold(left)
    text[:, BLOCK - 1] = core + 300
    text[:, BLOCK:-1] = _unfold(right)
    order = np.array(suffix_array(text.ravel().tolist()), np.int64)
    row, column = order // width, order % width
    whole = (column < BLOCK) & ((mask[row] >> np.minimum(column, BLOCK - 1)) & 1 > 0)
    row, column = row[whole], column[whole]
    symbols = text[row[:, None], column[:, None] + np.arange(BLOCK)]
    same = (column[1:] == column[:-1]) & (symbols[1:] == symbols[:-1]).all(1)
    out = np.zeros(n, np.int64)
    for k in (slice(1, None), slice(None, -1)):
        np.bitwise_or.at(out, row[k][same], 1 << column[k][same])
    return out


def _counted_blocks(core: np.ndarray, mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The result of ``repeated_blocks``, by counting each window's hash: for cores with very many blocks."""
    out = np.zeros(len(core), np.int64)
    for j in range(BLOCK):
        some = np.flatnonzero(mask >> j & 1)
        tail = left[some] >> np.uint64(9 * j)
        head = right[some] & np.uint64((1 << 9 * j) - 1)
        code, n = groups(common.mix(common.mix(core[some].astype(np.uint64)) ^ tail) ^ head * np.uint64(0x9E3779B97F4A7C15))
        out[some] |= (np.bincount(code, minlength=n) > 1)[code].astype(np.int64) << j
    return out


def _compare(bits: int, window: int):
    """One bucket: segments by suffix arrays, single windows by their count."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if got := _entries(table, 10):
            did, th, doc, within, count, lead, key, content, known, data = got
            count, lead = count.astype(np.int64), lead.astype(np.int64)
            size = count + window - 1
            group, _ = groups(key)
            equal, _ = groups(common.mix(key) ^ content)
            flags = shared_windows(data, np.cumsum(size) - size, count, lead, group, equal, window)
            flags[np.repeat(known > 0, count)] = False
            of, x, length = _runs(flags, count)
            rows += found_rows(bits, did, th, doc[of], within[of].astype(np.int64) + x, length)
        if got := _entries(table, 6):
            did, th, doc, at, key, known = got
            code, n = groups(key)
            hit = (np.bincount(code, minlength=n) + np.bincount(code, weights=known > 0, minlength=n) > 1)[code] & (known == 0)
            rows += found_rows(bits, did, th, doc[hit], at[hit].astype(np.int64), np.ones(hit.sum(), np.int64))
        return passed(table, rows)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, th, kept, n_bytes, n_removed, n_spans) and the columns of ``carry`` for each row of ``docs``.

    A byte is removed if a ``window``-byte string that also starts anywhere else
    covers it.  Null texts count as empty; texts shorter than the window stay.
    Repeated rows are places of their own, so each loses what the others have.
    ``th`` tells texts of one id apart; null ids are allowed.  ``kept`` is
    binary, or with ``as_text`` a string, without characters that were cut apart.
    """
    rows = keyed(docs, id_column, text, carry)
    bits = bucket_bits(docs, text)
    scanned = rows.select("did", "th", "text").mapInArrow(_scan(bits, window), ENTRIES)
    judged = scanned.groupBy("bucket").applyInArrow(_judge(bits), FOUND)
    # All columns of the documents, so that both joins read one exchange.
    columns = [*rows.columns, "parts"]
    pieces = rows.join(by_document(judged), ["did", "th"]).select(*columns).mapInArrow(_cut_out(bits, window), ENTRIES)
    covered = by_document(pieces.groupBy("bucket").applyInArrow(_compare(bits, window), FOUND))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.utf8(batch.column("text"))
            size = np.diff(offsets)
            edge = np.zeros(len(data) + 1, np.int64)
            for i, parts in enumerate(batch.column("parts")):
                for part in parts.values or ():
                    a, c = (x.astype(np.int64) for x in unpack(part.as_py()))
                    np.add.at(edge, offsets[i] + a, 1)
                    np.add.at(edge, offsets[i] + a + c + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offsets[:-1][size > 0]] = gone[offsets[:-1][size > 0]]
            at = np.concatenate(([0], np.cumsum(begins)))
            spans = at[offsets[1:]] - at[offsets[:-1]]
            left = data[~gone].tobytes()
            ends = (offsets - sums[offsets]).tolist()
            kept = [left[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            column = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            rest = [batch.column("rest")] if carry else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), *rest, column, pa.array(size), pa.array(removed), pa.array(spans)],
                names=["did", "th", *["rest"] * len(rest), "kept", "n_bytes", "n_removed", "n_spans"],
            )

    out = rows.join(covered, ["did", "th"], "left").select(*columns)
    head = out.select("did", "th", *["rest"] * bool(carry), F.lit("" if as_text else b"").alias("kept"), *[F.lit(0).cast("long").alias(k) for k in ("n_bytes", "n_removed", "n_spans")])
    out = out.mapInArrow(strip, head.schema)
    return out.select(F.when(F.col("did") < LAST_ID, F.col("did")).alias("doc_id"), "th", "kept", "n_bytes", "n_removed", "n_spans", *["rest.*"] * bool(carry))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans and the kept bytes of each text, straight from the definition, for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] = seen.get(r[i : i + window], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append((len(r), int(gone.sum()), len(common.runs(gone)[0]), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


