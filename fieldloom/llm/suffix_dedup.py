"""Removal of repeated byte strings, by blockwise suffix sorting over a difference cover.

Wanted are the suffixes whose first 400 bytes start another suffix, too (``BYTES``), and by the same
passes the words whose next 50 words stand elsewhere, too (``WORDS``): passages that are long in words
may be short in bytes. Sorting all suffixes would move many bytes for each byte of text, so it is done
in two sorts, one bucket at a time:

1. The cover sample. A cover holds residues modulo a period such that any two places are both
   carried onto residues of it by one common shift below the period. So any two equal strings of
   the wanted length hold, at the same depth, two sampled suffixes that agree in ``prefix`` units.
   Sampled suffixes (one in 13 for bytes) get the hash of their prefix as rank, are dealt into buckets
   by it, and each bucket is sorted by itself; ranks that occur once drop out.
2. The candidates. A suffix stays only if a repeated sample stands where its first units need one.
   Their ties are settled by a rank of the whole wanted length, sorted in buckets again.

Ranks are polynomial hashes, mixed; sampled ones travel as 32 bits besides their bucket, as they only
choose candidates. Ranks of candidates decide, so they have 96 bits from two hashes: if each of 10^14
suffixes were a candidate with units of its own, 0.06 pairs would be taken for equal. Tasks send a
bucket packed arrays: sampled ranks with their places, and candidates' ranks in order, as steps; the
answer to these is a bit each. A rank that a task saw twice is settled there and sent once, so a
string that a third of all texts share costs a bucket one entry a task. Buckets of either sort are
sized by the number of entries that the pass before it allows.

Texts are taken in chunks of about ``CHUNK`` bytes, named by their content. Answers for a chunk are
files of that name in the shared folder, where the task that reads the same chunk in the next pass
finds them: texts are never shuffled. A scan deals the same rows to a task each time; a chunk
without its file stops the run, so results can't be partial.

Equal texts are settled first, by SHA-256: a text that occurs twice, of 400 bytes or 50 words or more,
repeats as a whole, and one copy stands for all. Null texts are empty; shorter texts keep everything.
A text of many MB is a chunk of its own, hashed a block at a time. Rows that repeat are copies. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, store

CHUNK, BLOCK, BUCKET = 4 << 20, 1 << 20, 4_000_000


@cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """Singer's difference set for a prime q: the period, and q + 1 residues that differ by everything once.

    The powers of x, modulo an irreducible cubic of full order over the integers modulo q, whose
    coefficient of x * x is zero.
    """
    period = q * q + q + 1
    for a, b, c in ((a, b, c) for c in range(1, q) for b in range(q) for a in range(q)):
        v, found = (1, 0, 0), []
        for i in range(period):
            if not v[2]:
                found.append(i)
            v = ((v[2] * c) % q, (v[0] + v[2] * b) % q, (v[1] + v[2] * a) % q)  # x * v, with x^3 = a x^2 + b x + c
        if len(found) == q + 1 and len({(x - y) % period for x in found for y in found}) == period:
            return period, tuple(found)
    raise ValueError(f"{q} is not prime")


@dataclass(frozen=True)
class Scale:
    """What repeats: ``length`` units. The cover is made over the field of ``order`` elements."""

    name: str
    length: int
    order: int

    @property
    def period(self) -> int:
        return difference_cover(self.order)[0]

    @property
    def prefix(self) -> int:
        return self.length - self.period + 1

    @property
    def in_cover(self) -> np.ndarray:
        period, cover = difference_cover(self.order)
        out = np.zeros(period, bool)
        out[list(cover)] = True
        return out


BYTES, WORDS = Scale("bytes", 400, 13), Scale("words", 50, 5)
SCALES = (BYTES, WORDS)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    base = 0x9E3779B97F4A7C15
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        out = np.ones(BLOCK + max(s.length for s in SCALES) + 1, np.uint64)
        n, step = 1, np.uint64(x)
        while n < len(out):  # doubling: x^n times what is there
            m = min(n, len(out) - n)
            out[n : n + m] = out[:m] * step
            n, step = 2 * n, np.uint64(int(step) ** 2 % (1 << 64))
        both.append(out)
    return both[0], both[1]


@cache
def _values(salt: int) -> np.ndarray:
    """A random odd value for each byte."""
    return np.random.default_rng(42 + salt).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ranks(values: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of each run of ``width`` values; at most ``BLOCK`` runs."""
    power, inverse = _powers()
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * inverse[: max(0, len(values) - width + 1)]) if len(values) >= width else np.empty(0, np.uint64)


class Units:
    """The texts of a chunk as one sequence of bytes, or of words; ``values`` gives 64 bits for each of a stretch."""

    def __init__(self, values: Callable[[int, int, int], np.ndarray], sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.ends = np.cumsum(sizes)
        self.starts, self.total = self.ends - sizes, int(self.ends[-1])

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Stretches of at most ``BLOCK`` units: where they begin and end, and the place of each unit in its text and before its end."""
        for a in range(0, self.total, BLOCK):
            b = min(a + BLOCK, self.total)
            i, j = np.searchsorted(self.ends, [a, b - 1], side="right")
            s, e, at = self.starts[i : j + 1], self.ends[i : j + 1], np.arange(a, b)
            n = np.maximum(np.minimum(e, b) - np.maximum(s, a), 0)
            yield a, b, at - np.repeat(s, n), np.repeat(e, n) - at

    def ranks(self, a: int, b: int, width: int, salt: int = 0) -> np.ndarray:
        """Of the runs of ``width`` units that start from a up to b."""
        return ranks(self.values(a, min(b + width - 1, self.total), salt), width)


class Chunk:
    """Some texts, one after the other."""

    def __init__(self) -> None:
        self.keys: list[str] = []
        self.texts: list[bytes] = []
        self.size = 0

    def name(self, task: int, number: int) -> str:
        digest = hashlib.sha1(f"{task} {number}".encode())
        for k, t in zip(self.keys, self.texts, strict=True):
            digest.update(f"{k} {len(t)};".encode())
        return digest.hexdigest()[:20]

    def units(self) -> dict[Scale, Units]:
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        words, counts = _words(data, np.cumsum(sizes) - sizes)
        salted = lambda a, b, salt: mixed(words[a:b] ^ _values(salt)[0]) if salt else words[a:b]
        return {BYTES: Units(lambda a, b, salt: _values(salt)[data[a:b]], sizes), WORDS: Units(salted, counts)}


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word parted by ASCII white space, and how many words each text has."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    dark = ~blank[data]
    first = dark.copy()
    first[1:] &= ~dark[:-1]
    own = starts[starts < len(data)]
    first[own] = dark[own]
    begin = np.flatnonzero(first)
    counts = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))
    if not len(begin):
        return np.empty(0, np.uint64), counts
    power, out = _powers()[0], np.empty(len(begin), np.uint64)
    edges = np.append(begin, len(data))
    i = 0
    while i < len(begin):  # some words at a time
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + BLOCK, side="right")) - 1)
        a, b = int(edges[i]), int(edges[j])
        within = np.arange(a, b) - np.repeat(begin[i:j], np.diff(edges[i : j + 1]))
        each = np.where(dark[a:b], _values(0)[data[a:b]] * power[within % BLOCK], np.uint64(0))
        out[i:j] = np.add.reduceat(each, begin[i:j] - a)
        i = j
    return mixed(out), counts


def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
    from pyspark import TaskContext

    task, number, c = TaskContext.get().partitionId(), 0, Chunk()
    for b in it:
        for key, text in zip(b.column(0), b.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            c.keys.append(key.as_py())
            c.texts.append(raw)
            c.size += len(raw)
            if c.size >= CHUNK:
                yield c.name(task, number), c
                number, c = number + 1, Chunk()
    if c.keys:
        yield c.name(task, number), c


def settle(found: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ranks: their order, which of them in that order is the first of its kind, and which has no equal here."""
    order = np.argsort(found, kind="stable")
    h = found[order]
    same = h[1:] == h[:-1]
    if more is not None:
        rest = more[order]
        equal = rest[1:] == rest[:-1]
        if (same & ~equal).any():  # two of one hash that differ in the other: these may alternate
            order = np.lexsort((more, found))
            h, rest = found[order], more[order]
            same, equal = h[1:] == h[:-1], rest[1:] == rest[:-1]
        same &= equal
    first, last = np.ones(len(h), bool), np.ones(len(h), bool)
    first[1:], last[:-1] = ~same, ~same
    return order, first, first & last


def sampled(units: Units, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """Rank and place of the cover sample."""
    all_found, all_places, period, in_cover = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], scale.period, scale.in_cover
    for a, b, at, left in units.parts():
        take = np.flatnonzero(in_cover[at % period] & (left >= scale.prefix))
        if len(take):
            all_found.append(units.ranks(a, b, scale.prefix)[take])
            all_places.append(take + a)
    return np.concatenate(all_found), np.concatenate(all_places)


def allowed(units: Units, scale: Scale, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ranks and the place of suffixes with a repeated sample less than a period in."""
    found, more, places = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    text = np.searchsorted(units.ends, repeated, side="right")
    low = np.maximum(repeated - (scale.period - 1), units.starts[text])
    for a, b, _, left in units.parts():
        i, j = np.searchsorted(repeated, [a, b + scale.period - 1])
        some = slice(i, j)
        inside = low[some] < b
        if not inside.any():
            continue
        mark = np.zeros(b - a + 1, np.int32)
        np.add.at(mark, np.maximum(low[some][inside], a) - a, 1)
        np.add.at(mark, np.minimum(repeated[some][inside], b - 1) + 1 - a, -1)
        take = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (left >= scale.length))
        if len(take):
            found.append(units.ranks(a, b, scale.length)[take])
            more.append((units.ranks(a, b, scale.length, 1)[take] >> np.uint64(32)).astype(np.uint32))
            places.append(take + a)
    return np.concatenate(found), np.concatenate(more), np.concatenate(places)


# Packets: rows (bucket, chunk, payload). Buckets of the second scale are numbered after those of the first.

PACKETS = "bucket int, chunk string, payload binary"
Packet = tuple[int, str, bytes]


def bounds(found: np.ndarray, buckets: int) -> np.ndarray:
    """Where in the order of ranks each bucket begins."""
    into = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(into, np.arange(buckets + 1, dtype=np.uint64))


def sample_packets(name: str, found: np.ndarray, places: np.ndarray, ask: np.ndarray, buckets: int, base: int) -> Iterator[Packet]:
    """32 bits of each rank, and the gaps between places in order; a place that wants no answer has none."""
    into = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.lexsort((places, ~ask, into))
    found, places, ask, into = found[order], places[order], ask[order], into[order]
    edges = np.searchsorted(into, np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edges)):
        a, b = edges[k], edges[k + 1]
        asked = int(ask[a:b].sum())
        gaps = np.diff(places[a : a + asked], prepend=0)
        wide = bool(asked and gaps.max() > 0xFFFF)
        head = np.array([b - a, asked, wide], np.uint32).tobytes()
        yield base + int(k), name, head + found[a:b].astype(np.uint32).tobytes() + gaps.astype(np.uint32 if wide else np.uint16).tobytes()
    yield base + int(name[:20], 16) % buckets, name, np.zeros(3, np.uint32).tobytes()  # so that a chunk without samples gets its file, too


def sample_unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, asked, wide = np.frombuffer(payload, np.uint32, 3).tolist()
    gaps = np.frombuffer(payload, np.uint32 if wide else np.uint16, asked, 12 + 4 * n)
    return np.frombuffer(payload, np.uint32, n, 12), np.cumsum(gaps.astype(np.int64))


def packed(found: np.ndarray, more: np.ndarray) -> bytes:
    """Ranks in order: the steps between the first 64 bits, in six bytes where that is enough, then the other 32."""
    steps = np.diff(found, prepend=np.uint64(0))
    size = 6 if not len(steps) or int(steps[1:].max(initial=0)) < 1 << 48 else 8
    head = np.array([len(found), size], np.uint32).tobytes() + found[:1].tobytes()
    return head + np.ascontiguousarray(steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes() + more.astype("<u4").tobytes()


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(payload, np.uint32, 2).tolist()
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    steps = np.zeros((n, 8), np.uint8)
    steps[1:, :size] = np.frombuffer(payload, np.uint8, (n - 1) * size, 16).reshape(-1, size)
    steps = steps.view("<u8").ravel()
    steps[0] = np.frombuffer(payload, np.uint64, 1, 8)[0]
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(payload, "<u4", n, 16 + (n - 1) * size)


def rank_packets(name: str, found: np.ndarray, more: np.ndarray, buckets: int, base: int) -> Iterator[Packet]:
    """From ranks in order."""
    edges = bounds(found, buckets)
    for k in np.flatnonzero(np.diff(edges)):
        yield base + int(k), name, packed(found[edges[k] : edges[k + 1]], more[edges[k] : edges[k + 1]])
    yield base + int(name[:20], 16) % buckets, name, packed(found[:0], more[:0])


def _rows(rows: Iterator[Packet]) -> Iterator[pa.RecordBatch]:
    some: list[Packet] = []
    kinds = (("bucket", pa.int32()), ("chunk", pa.string()), ("payload", pa.binary()))
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
    size = 0
    for r in rows:
        some.append(r)
        size += len(r[2])
        if size >= BLOCK:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


def sample(buckets: dict[Scale, int], local: str):
    """Pass 1: ranks of the sampled suffixes. Places of those that repeat inside a chunk are kept in ``local``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, c in chunks(it):
                for scale, units in c.units().items():
                    found, places = sampled(units, scale)
                    order, first, alone = settle(found)
                    twice = places[order[~alone]]
                    store.write(local, f"{name}-{scale.name}", np.sort(twice).astype(np.uint32).tobytes())
                    one = order[first]
                    yield from sample_packets(f"{name}-{scale.name}", found[one], places[one], alone[first], buckets[scale], _base(buckets, scale))

        yield from _rows(rows())

    return run


def _base(buckets: dict[Scale, int], scale: Scale) -> int:
    return 0 if scale is SCALES[0] else buckets[SCALES[0]]


def sample_answer(table: pa.Table) -> pa.Table:
    """Sort one bucket; each chunk gets the places whose rank stands in another, too."""
    got = [sample_unpacked(x.as_buffer().to_pybytes()) for x in table.column("payload").combine_chunks()]
    every = np.sort(np.concatenate([x for x, _ in got]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for found, places in got:
        mine = found[: len(places)]
        hit = places[twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine] if len(twice) else places[:0]
        out.append(hit.astype(np.uint32).tobytes())
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "answer": pa.array(out, pa.binary())})


def rank_answer(table: pa.Table) -> pa.Table:
    """Sort one bucket; each chunk gets a bit for each of its ranks: whether another chunk has it, too."""
    got = [unpacked(x.as_buffer().to_pybytes()) for x in table.column("payload").combine_chunks()]
    order, _, alone = settle(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
    hit = np.empty(len(order), bool)
    hit[order] = ~alone
    edges = np.cumsum([0, *[len(x) for x, _ in got]])
    out = [np.packbits(hit[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "answer": pa.array(out, pa.binary())})


ANSWERS = "bucket int, chunk string, answer binary"


def deliver(answers: DataFrame, folder: str, parts: int, local: str | None = None) -> dict[str, int]:
    """A file for each chunk with its answers by bucket. With ``local``: how many suffixes of each scale they may allow at most."""
    period = {s.name: s.period for s in SCALES}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, some, seen = None, [], {s.name: 0 for s in SCALES}

        def flush() -> None:
            data = b"".join(some)
            if local is not None:
                data = np.union1d(np.frombuffer(data, np.uint32), np.frombuffer(store.read(local, name), np.uint32)).astype(np.uint32)
                scale = name.rpartition("-")[2]
                seen[scale] += int(np.minimum(np.diff(data), period[scale]).sum()) + period[scale] * bool(len(data))
                data = data.tobytes()
            store.write(folder, name, data)

        for b in it:
            for key, answer in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != name:
                    if name is not None:
                        flush()
                    name, some = key, []
                some.append(answer)
        if name is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["scale", "n"])

    made = answers.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, "scale string, n bigint")
    return {r["scale"]: r["n"] for r in made.groupBy("scale").agg(F.sum("n").alias("n")).collect()}


def answered(folder: str, name: str) -> bytes:
    data = store.read(folder, name)
    if data is None:
        raise RuntimeError(f"no answer for chunk {name}: the rows of its task differ from those of the pass before")
    return data


def ordered(units: Units, scale: Scale, folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a chunk, each rank once and in order: both ranks and the place; and the places whose rank repeats here."""
    repeated = np.frombuffer(answered(folder, f"{name}-{scale.name}"), np.uint32).astype(np.int64)
    found, more, places = allowed(units, scale, repeated)
    order, first, alone = settle(found, more)
    one = order[first]
    return found[one], more[one], places[one], places[order[~alone]] if not alone.all() else places[:0]


def candidates(folder: str, buckets: dict[Scale, int]):
    """Pass 2: ranks of the suffixes that a repeated sample allows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, c in chunks(it):
                for scale, units in c.units().items():
                    found, more, _, _ = ordered(units, scale, folder, name)
                    yield from rank_packets(f"{name}-{scale.name}", found, more, buckets[scale], _base(buckets, scale))

        yield from _rows(rows())

    return run


def starts(units: Units, scale: Scale, ranked: str, final: str, buckets: int, name: str) -> np.ndarray:
    """Places of a chunk whose next ``length`` units stand elsewhere, too."""
    found, _, places, here = ordered(units, scale, ranked, name)
    bits = np.frombuffer(answered(final, f"{name}-{scale.name}"), np.uint8)
    edges, hits, at = bounds(found, buckets), [here], 0
    for k in np.flatnonzero(np.diff(edges)):
        n = int(edges[k + 1] - edges[k])
        size = (n + 7) // 8
        hits.append(places[edges[k] : edges[k + 1]][np.unpackbits(bits[at : at + size], count=n).astype(bool)])
        at += size
    if at != len(bits):
        raise RuntimeError(f"answer for chunk {name} has {len(bits)} bytes, not {at}")
    return np.unique(np.concatenate(hits))


LEFT = (("__key", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_words", pa.int64()), ("n_passage_words", pa.int64()), ("__kept", pa.string()))


def cut(ranked: str, final: str, buckets: dict[Scale, int], texts: bool):
    """Pass 3: what is left of each text."""

    def each(c: Chunk, units: Units, scale: Scale, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = starts(units, scale, ranked, final, buckets[scale], name)
        edges = np.searchsorted(found, np.append(units.starts, units.total))
        for i, at in enumerate(units.starts):
            yield runs(found[edges[i] : edges[i + 1]] - at, scale.length)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, c in chunks(it):
            units, rows = c.units(), []
            passages = [int((end - begin).sum()) for begin, end in each(c, units[WORDS], WORDS, name)]
            for i, (begin, end) in enumerate(each(c, units[BYTES], BYTES, name)):
                kept = remainder(c.texts[i], begin, end)
                rows.append((c.keys[i], int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), int(units[WORDS].sizes[i]), passages[i], kept.decode(errors="ignore") if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(LEFT)], [n for n, _ in LEFT])

    return run


def runs(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that strings of ``length`` from these places cover."""
    if not len(found):
        return found, found
    breaks = np.flatnonzero(np.diff(found) > length)
    return found[np.append(0, breaks + 1)], found[np.append(breaks, len(found) - 1)] + length


def remainder(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def settled(docs: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Staged rows (doc_id, __sha, n_bytes, whether others have the text), and staged answers by ``__k``, the hash of a text."""
    spark = docs.sparkSession
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("__raw")).withColumn("__sha", F.sha2("__raw", 256))
    rows = shared.stage(raw.select("doc_id", "__sha", F.length("__raw").cast("long").alias("n_bytes")), "suffix-rows")
    groups = rows.groupBy("__sha", "n_bytes").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = shared.stage(groups.filter("n > 1").select(F.col("__sha").alias("__s"), F.col("first").alias("__first")), "suffix-copies")
    least = min(BYTES.length, 2 * WORDS.length - 1)  # bytes of the shortest text with a string of either scale
    total = rows.filter(F.col("n_bytes") >= least).agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    small = shared.is_small(copied, 100)
    one = raw.filter(F.length("__raw") >= least).join(F.broadcast(copied) if small else copied, F.col("__sha") == F.col("__s"), "left")
    one = one.filter(F.col("__s").isNull() | F.col("doc_id").eqNullSafe(F.col("__first"))).select("__sha", "__raw")
    if not small:  # a shuffle hands rows over in no fixed order
        one = shared.stage(one, "suffix-texts")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked, local, final = (shared.fresh_path(spark, f"suffix-{x}") for x in ("ranks", "local", "final"))
    entries = {s: total * s.in_cover.sum() // s.period // (1 if s is BYTES else 2) for s in SCALES}
    buckets = {s: max(parts, int(n) // BUCKET) for s, n in entries.items()}
    asked = one.mapInArrow(sample(buckets, local), PACKETS).groupBy("bucket").applyInArrow(sample_answer, ANSWERS)
    allowed_by = deliver(asked, ranked, parts, local)
    buckets = {s: max(parts, allowed_by.get(s.name, 0) // BUCKET) for s in SCALES}
    asked = one.mapInArrow(candidates(ranked, buckets), PACKETS).groupBy("bucket").applyInArrow(rank_answer, ANSWERS)
    deliver(asked, final, parts)
    kinds = {pa.string(): "string", pa.int64(): "bigint"}
    left = one.mapInArrow(cut(ranked, final, buckets, texts), ", ".join(f"{n} {kinds[k]}" for n, k in LEFT))
    left = shared.stage(left.dropDuplicates(["__key"]), "suffix-left").withColumnRenamed("__key", "__k")
    twice = shared.stage(copied.select("__s"), "suffix-twice")
    rows = rows.join(twice, F.col("__sha") == F.col("__s"), "left").withColumn("__copied", F.col("__s").isNotNull()).drop("__s")
    return rows, left


def repeats(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage_words: words in runs of 50 and more that stand elsewhere, too."""
    rows, left = settled(docs, False)
    out = rows.join(left, F.col("__sha") == F.col("__k"), "left")
    whole = F.col("__copied") & (F.col("n_bytes") >= BYTES.length)
    pick = lambda a, b, c: F.when(whole, a).otherwise(F.coalesce(b, c))
    none = F.lit(0).cast("long")
    words = F.when(F.col("__copied") & (F.col("n_words") >= WORDS.length), F.col("n_words")).otherwise(F.coalesce("n_passage_words", none))
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", none).alias("n_removed"), pick(F.lit(1).cast("long"), "n_spans", none).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("__sha")).alias("kept_sha256"), words.alias("n_passage_words"),
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out of their texts; what a cut leaves of a character goes, too. Null texts stay null."""
    rows, left = settled(docs, True)
    rows = rows.filter((F.col("n_bytes") >= BYTES.length)).join(left, F.col("__sha") == F.col("__k"), "left")
    kept = rows.select("__sha", F.when(F.col("__copied"), F.lit("")).otherwise(F.col("__kept")).alias("__kept")).distinct().withColumnRenamed("__sha", "__k")
    every = shared.whole_row(docs).withColumn("__sha", _sha(F.col("__row.text"))).join(kept, F.col("__sha") == F.col("__k"), "left")
    text = F.when(F.col("__row.text").isNotNull(), F.coalesce("__kept", F.col("__row.text")))
    return every.select(*[(text if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    return repeats(docs)
