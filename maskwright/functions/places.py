"""Places of words and of neighbouring words in texts: whole Arrow batches at once in numpy, as folds over arrays cost microseconds a word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text looked at together, and places handed on together.
RUN, ROWS = 1 << 21, 1 << 18
#: Bits of a filter: so many for each piece asked for, 2**MOST at most.
BITS, MOST = 32, 28

_U = np.uint64
_WORD = np.array([chr(c).isalnum() or chr(c) == "_" if c < 128 else False for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_M1, _M2, _ODD = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_LONG = 256  # bytes of a piece that are mixed in eights; what follows counts by its crc
#: Letters outside ASCII whose lower case holds ASCII letters.
_ODDITIES = ("\u212a".encode(), "\u0130".encode())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> _U(32)
    x *= _M2
    x ^= x >> _U(29)
    return x


def _digests(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit digests of pieces of ``data``, which has eight bytes to spare at its end."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = _mix(size.astype(_U) + (eights[begin] & _MASK[np.minimum(size, 8)]))
    step, more = 8, np.flatnonzero(size > 8)
    while len(more) and step < _LONG:
        out[more] = _mix(out[more] + (eights[begin[more] + step] & _MASK[np.minimum(size[more] - step, 8)]))
        step, more = step + 8, more[size[more] > step + 8]
    for i in more:
        out[i] = _mix(out[i : i + 1] + _U(zlib.crc32(data[begin[i] + step : begin[i] + size[i]])))[0]
    return out


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``RUN`` bytes, one text at least."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + RUN, "right")) - 1)
        yield lo, hi
        lo = hi


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of each word of texts that begin at ``at``, which ends with the end of the last."""
    word, n = _WORD[data], int(at[-1])
    first, last = word.copy(), word
    first[1:] &= ~word[:-1]
    head = at[:-1][at[:-1] < n]
    first[head] = word[head]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tail = at[1:][at[1:] > 0] - 1
    last[tail] = word[tail]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(begin, at)))


def _cuts(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as strings."""
    ends = np.cumsum(size)
    took = data[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.concatenate([[0], ends]).astype("<i4")), pa.py_buffer(took))


def places(rows: DataFrame, kind: str, wanted: Broadcast | None = None) -> DataFrame:
    """Words (``[A-Za-z0-9_]+``) of texts, or each two neighbouring ones with what lies between.

    ``rows`` have a key and a text that is not null; ``kind`` is ``words``, ``pairs``, ``both``, or
    ``least``: pairs, or the only word of a text that has one. A row has _key, byte place _at, _cut,
    _pair, _same (its words are alike, case apart) and _hash, which pieces that are alike, case apart,
    share. ``wanted``, from ``asked``, drops most pieces whose _hash was not asked for.
    """
    key, text = rows.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        for batch in (b for b in batches if b.num_rows):
            keys, texts = batch.column(0), batch.column(1).cast(pa.string())
            whole = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for lo, hi in _runs(whole):
                at = whole[lo : hi + 1] - whole[lo]
                data = np.zeros(int(at[-1]) + 8, np.uint8)
                data[:-8] = raw[whole[lo] : whole[hi]]
                begin, end, owner = _words(data[:-8], at)
                if len(begin):
                    yield from _found(data, begin, end, owner, at, kind, bits, keys.slice(lo, hi - lo))

    kinds = f"_key {rows.schema[key].dataType.simpleString()}, _at int, _cut string, _pair boolean, _same boolean, _hash long"
    return rows.select(key, F.col(text).cast("string")).mapInArrow(find, kinds)


def _found(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, at: np.ndarray, kind: str, bits: np.ndarray | None, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of ``places`` for the words of a run of texts."""
    low = _LOWER[data]
    word = _digests(low, begin, end - begin)
    beside = owner[1:] == owner[:-1]
    out = []
    if kind != "words":
        i = np.flatnonzero(beside)
        gap, until = end[i], begin[i + 1]
        between = _digests(data, gap, until - gap)
        high = np.cumsum(data >= 128, dtype=np.int32)
        other = high[until - 1] > high[gap - 1]  # has lower case of its own
        between[other] = _ODD
        same = word[i] == word[i + 1]
        digest = _mix(_mix(word[i] * _ODD ^ between) + word[i + 1])
        held = data.tobytes()
        sure = other if any(x in held for x in _ODDITIES) else None
        out.append((i, begin[i], end[i + 1], True, same, digest, sure))
    if kind != "pairs":
        lone = np.arange(len(begin))
        if kind == "least":
            near = np.zeros(len(begin), bool)
            near[:-1] |= beside
            near[1:] |= beside
            lone = np.flatnonzero(~near)
        out.append((lone, begin[lone], end[lone], False, np.zeros(len(lone), bool), word[lone], None))
    for i, a, b, pair, same, digest, sure in out:
        if bits is not None:
            slot = digest >> _U(64 - (8 * len(bits)).bit_length() + 1)
            use = (bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1 > 0
            keep = np.flatnonzero(use if sure is None else use | sure)
            i, a, b, same, digest = (x[keep] for x in (i, a, b, same, digest))
        for k in range(0, len(i), ROWS):
            part = slice(k, k + ROWS)
            mine = owner[i[part]]
            columns = [keys.take(pa.array(mine)), pa.array((a[part] - at[mine]).astype(np.int32)), _cuts(data, a[part], b[part] - a[part]), pa.array(np.full(len(mine), pair)), pa.array(same[part]), pa.array(digest[part].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_at", "_cut", "_pair", "_same", "_hash"])


def asked(hashes: DataFrame, n: int) -> Broadcast | None:
    """A filter of the column _hash of about ``n`` rows: a bit for each, in 32 MB at most, built in parts by tasks; none where all bits would be set."""
    if n >> MOST:
        return None
    b = min(MOST, max(15, (BITS * n).bit_length()))
    share = 1 << b - 6
    slot = F.shiftrightunsigned("_hash", 64 - b)

    def pack(data: pa.Table) -> pa.Table:
        bits = np.zeros(share, bool)
        slots = data.column("slot").to_numpy()
        bits[slots % share] = True
        return pa.table({"part": [int(slots[0]) // share], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("part", pa.int64()), ("bits", pa.binary())]))

    parts = hashes.select(slot.alias("slot")).distinct().withColumn("part", F.shiftright("slot", b - 6)).groupBy("part").applyInArrow(pack, "part long, bits binary").collect()
    out = np.zeros(1 << b - 3, np.uint8)
    for part, bits in parts:
        out[part * share // 8 : (part + 1) * share // 8] = np.frombuffer(bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)
