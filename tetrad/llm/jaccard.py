"""N-gram Jaccard join by partitions of the universe.

Two texts link when their sets of word n-grams have a Jaccard similarity of at
least ``num / den``.  Then their symmetric difference is at most
h = (den - num) (|a| + |b|) / (den + num), so if one of them is cut into parts
of the hashed universe, at least one of any h + 1 of its parts is the same in
the other (pigeonhole).  Parts are made for bands of sizes a factor den / num
apart: a set is indexed by all its parts of its own band's cut, and looks up
h + 1 of its parts in its own band's and the next smaller band's cut, so that
every pair within reach meets in the larger set's look-up.  A part that has two
n-grams or more may also be looked up with its one-deletion neighbourhood (the
part and itself less each of its members, on both sides), which catches one
difference more and so counts as two parts.

Which parts are looked up is chosen by cost, from counted buckets:

1. All parts of all sets are counted in their buckets.  A set of p parts needs
   p - h of them met by others; sets that fall short (texts that only share a
   passage, mostly) have no partner and go (``alive``).
2. The parts of those left are counted again, with their deletions.  Parts that
   nobody shares are looked up for nothing, then each set looks up its cheapest
   parts and deletions until h + 1 differences are caught (``weighed``).
3. A bucket that somebody looks up gives one row a member: the member and the
   bucket's first set, its leader (``met``).  First each set is compared with the
   leader it shares most buckets with, then with its others, then the members
   of a leader that are still in different components with each other, in
   blocks that never leave a task: only links are put out, no pairs.

Equal sets are one node throughout.  Sets are compared by the 64-bit hashes of
their n-grams.  ``linked_classes`` also counts each row's links: all pairs of
different sets of a component are compared, in such blocks too.

Defined results: texts are lower-cased in A-Z only; null and empty texts have
the empty set, which is linked with nothing, not even another empty set (its
component is its own id); a text of fewer words than ``n`` has its whole word
sequence as one n-gram; texts of any length are taken whole; every row takes
part and gets its result, rows of the same id and rows without one too; a
component of rows without ids alone has none; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetrad.llm import kernels as K
from tetrad.llm.components import components
from tetrad.llm.shared import blocks, collect_garbage, release, small_batches, text_bytes, texts, unused, written

#: The chance that a set has fewer parts than it must look up is held below two to minus this.
SURE = 80
#: Sets, and n-grams, of a share of a group whose sets are compared with each other, about; n-grams compared at a time.
SHARE, GRAMS, WIDTH = 2048, 1_500_000, 4096
#: Entries that a task holds before it sends them.
HELD = 500_000
#: Bits that a filter of sets has for each.
PROBES = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Rule:
    """n-grams of ``n`` words; similarity of at least num / den."""

    n: int = 5
    num: int = 75
    den: int = 100

    def difference(self, a, b):
        """Largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)


@cache
def bands(rule: Rule, most: int) -> list[int]:
    """Largest size of each band, up to one that holds ``most``."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * rule.den // rule.num))
    return out


@cache
def parts_of(rule: Rule, low: int, high: int) -> int:
    """Into how many parts the universe is cut for sets of low to high n-grams:
    one for every two n-grams, and so many that every set has the parts that it
    must look up.  (The chance that n n-grams lie in k of m parts is less than
    (m over k) (k / m)^n; for small sets that takes a part for each n-gram.)"""

    def sure(m: int) -> bool:
        for n in {low, high}:
            k = rule.difference(n, n)
            if 0 < k and (k >= m or math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + n * math.log(k / m) > -SURE * math.log(2)):
                return False
        return True

    m = max(1, -(-high // 2))
    if sure(m):
        return m
    top = m
    while not sure(top) and top < 1 << 32:
        top *= 2
    while m < top - 1:
        middle = (m + top) // 2
        m, top = (m, middle) if sure(middle) else (middle, top)
    return min(top, 1 << 32)


# ---- sets -------------------------------------------------------------------


def shingles(column: pa.Array, rule: Rule) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: first row, sorted distinct n-gram hashes of all its texts, bounds."""
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        part, at = K.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends = K.spans(~K.WHITE[part], at)
        words = K.hashes(part, starts, ends)
        count = np.bincount(K.owners(starts, at), minlength=b - a)
        last = np.cumsum(count)
        grams = K.ngrams(words, rule.n)
        sets, bounds = [], [0]
        for n, end in zip(count.tolist(), last.tolist(), strict=True):
            if n >= rule.n:
                own = np.sort(grams[end - n : end - rule.n + 1])
                if len(own) > 1:
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                own = K.ngrams(words[end - n : end], n) ^ np.uint64(n)
            else:
                own = words[:0]
            sets.append(own)
            bounds.append(bounds[-1] + len(own))
        yield a, np.concatenate(sets) if sets else words[:0], np.array(bounds, np.int64)


def keys_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit key of each set, 0 for the empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    there = np.flatnonzero(np.diff(bounds))
    if len(there):
        out[there] = np.add.reduceat(K.mix(grams * _MIX + np.uint64(5)), bounds[there])
        out[there] = (K.mix(out[there] + (bounds[there + 1] - bounds[there]).astype(np.uint64)) >> np.uint64(1)) | np.uint64(1)
    return out


def _read(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sets of a batch of texts, or of stored sets."""
    if "grams" not in batch.schema.names:
        yield from shingles(batch.column(0), rule)
        return
    raw = batch.column("grams").to_pylist()
    sizes = [len(x) // 8 for x in raw]
    yield 0, np.frombuffer(b"".join(raw), np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def stored(docs: DataFrame, rule: Rule, bits: np.ndarray, text: str = "text") -> DataFrame:
    """Written table (k, grams) of the different sets that a filter lets through,
    so that later passes need not cut the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own, out = [], []
            for _, grams, bounds in shingles(batch.column(0), rule):
                keys = keys_of(grams, bounds)
                for i in np.flatnonzero(_passes(bits, keys)):
                    if (k := int(keys[i])) not in seen:
                        seen.add(k)
                        own.append(k)
                        out.append(grams[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(out, pa.binary())], ["k", "grams"])
        release()

    return written(texts(docs, text=text).mapInArrow(run, "k long, grams binary").dropDuplicates(["k"]), "set-store")


def sets(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_key) of every text; set_key is null for empty sets."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, grams, bounds in shingles(batch.column("text"), rule):
                sizes.append(np.diff(bounds))
                found.append(keys_of(grams, bounds))
            set_key = np.concatenate(found).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(set_key, mask=set_key == 0)], [key, "n_shingles", "set_key"])

    source = texts(docs, key, text=text)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, n_shingles long, set_key long")


# ---- entries ----------------------------------------------------------------


class Entries:
    """The parts of sets given as sorted hashes with bounds: signature, number
    of the set, whether it is a part of the next smaller band's cut (which only
    looks up), whether it is a part less one member (with ``deletions`` only),
    the part's number, and whether the part has two members or more."""

    def __init__(self, grams: np.ndarray, bounds: np.ndarray, rule: Rule, deletions: bool = False) -> None:
        sizes = np.diff(bounds)
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        tops = np.array(bands(rule, int(sizes.max()) if len(sizes) else 1), np.int64)
        lows = np.concatenate([[1], tops[:-1] + 1])
        cuts = np.array([parts_of(rule, int(a), int(b)) for a, b in zip(lows, tops, strict=True)], np.uint64)
        band = np.searchsorted(tops, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        values = K.mix(grams + np.uint64(11))
        made = 0
        for lower in (0, 1):
            at = band - lower
            keep = (at >= 0)[owner]
            g, o, v = grams[keep], owner[keep], values[keep]
            if not len(g):
                continue
            part = ((g >> np.uint64(32)) * cuts[at[o]]) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (part[1:] != part[:-1])]))
            total, count = np.add.reduceat(v, first), np.diff(np.append(first, len(g)))
            whose = o[first]
            salt = K.mix(part[first] * np.uint64(2) + (at[whose].astype(np.uint64) + np.uint64(1)) * _MIX)
            new = [(K.mix(total + salt), whose, np.full(len(first), bool(lower)), np.full(len(first), False), made + np.arange(len(first)), count > 1)]
            if deletions:
                mine = np.repeat(np.arange(len(first)), count)
                mine_of = np.flatnonzero((count > 1)[mine])
                of = mine[mine_of]
                new.append((K.mix((total + salt)[of] - v[mine_of]), whose[of], np.full(len(of), bool(lower)), np.full(len(of), True), made + of, np.full(len(of), True)))
            made += len(first)
            for entry in new:
                for into, x in zip(out, entry, strict=True):
                    into.append(x)
        kinds = (np.uint64, np.int64, bool, bool, np.int64, bool)
        self.signature, self.owner, self.lower, self.less, self.part, self.plural = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))


def _places(keys: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of a filter of so many bits that each key has, and the bit in each."""
    for i in range(PROBES):
        at = K.mix(keys + np.uint64(i << 32)) % np.uint64(bits)
        yield (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sets that a filter lets through; empty ones never."""
    out = keys != 0
    for byte, bit in _places(keys, 8 * len(bits)):
        out &= (bits[byte] >> bit & 1).astype(bool)
    return out


def _of_five(raw: list[bytes]) -> np.ndarray:
    joined = b"".join(raw)
    out = np.zeros((len(joined) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(joined, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _five(values: np.ndarray) -> np.ndarray:
    """The low 5 bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _dealt(target: np.ndarray, targets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of targets, and (target, from, to) of those that there are."""
    order = np.argsort(target, kind="stable")
    cut = np.searchsorted(target[order], np.arange(targets + 1).astype(target.dtype))
    return order, [(t, int(cut[t]), int(cut[t + 1])) for t in np.flatnonzero(cut[1:] > cut[:-1]).tolist()]


def _few(values: np.ndarray) -> bytes:
    """Numbers of 16 bits, or of 32 if one is larger."""
    return values.astype("<u2" if not len(values) or int(values.max()) < 1 << 16 else "<u4").tobytes()


def _of_few(raw: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(raw, sizes, strict=True))]).astype(np.int64)


#: A row of entries for a target: keys of sets, how many entries each has, and the entries' signatures (39 of their
#: bits, besides those that the target tells, and whether they are of the next smaller band's cut); and, for the target
#: that judges a set, keys of sets in one of their cuts (doubled, odd in the next smaller band's) with what is known
#: of them: size, parts, parts of two members or more.
_ENTRIES = "target int, keys binary, counts binary, signatures binary, known binary, facts binary"
#: Besides: whether an entry is of a part of two members or more (1), less one of them (2), and which part it is of.
_PARTS = ", kinds binary, part binary"


def _judge(key: np.ndarray, targets: int) -> np.ndarray:
    """The target that judges each set."""
    return (K.mix(key + np.uint64(9)) % np.uint64(targets)).astype(np.int64)


def _packed(source: DataFrame, rule: Rule, deletions: bool = False) -> DataFrame:
    """A task's entries by target; with ``deletions`` those of parts less a member too."""
    labels = _labels(source.sparkSession)
    targets = len(labels)

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, size, sig, own, less, part, plural = (np.concatenate(x) for x in held)
        parts, plurals = np.bincount(own[~less], minlength=2 * len(key)), np.bincount(own[~less & plural], minlength=2 * len(key))
        kind = plural.astype(np.uint8) | less.astype(np.uint8) << 1
        cuts = np.unique(own)
        doubled = key[cuts >> 1] << np.uint64(1) | (cuts & 1).astype(np.uint64)
        facts = np.stack([size[cuts >> 1], parts[cuts], plurals[cuts]]).astype("<u4")
        told, told_shares = _dealt(_judge(key[cuts >> 1], targets), targets)
        told_of = {t: told[a:b] for t, a, b in told_shares}
        # a part's number within its set
        least = np.full(2 * len(key), 1 << 62, np.int64)
        np.minimum.at(least, own, part)
        part = part - least[own]
        target = ((sig >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)
        order = np.lexsort((own >> 1, target))
        cut = np.searchsorted(target[order], np.arange(targets + 1).astype(np.uint64))
        told_sig = sig << np.uint64(1) | (own & 1).astype(np.uint64)
        rows: list[list] = [[] for _ in range(8)]
        for t in range(targets):
            which, known = order[cut[t] : cut[t + 1]], told_of.get(t, _NONE)
            if not len(which) and not len(known):
                continue
            mine, count = np.unique(own[which] >> 1, return_counts=True)
            row = (labels[t], key[mine].tobytes(), _few(count), _five(told_sig[which]).tobytes())
            row += (doubled[known].tobytes(), facts[:, known].tobytes(), kind[which].tobytes(), _few(part[which]))
            for into, x in zip(rows, row, strict=True):
                into.append(x)
        names = ["target", "keys", "counts", "signatures", "known", "facts", "kinds", "part"]
        n = 8 if deletions else 6
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:n]]], names[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(7)]
        n = count = made = 0
        seen: set[int] = set()
        for batch in batches:
            for _, grams, bounds in _read(batch, rule):
                found = keys_of(grams, bounds)
                fresh = (found != 0) & np.array([k not in seen for k in found.tolist()], bool)
                # a set that comes twice in one block counts once
                once = np.zeros(len(found), bool)
                once[np.unique(found, return_index=True)[1]] = True
                fresh &= once
                if not fresh.any():
                    continue
                seen.update(found[fresh].tolist())
                size = np.diff(bounds)[fresh]
                e = Entries(grams[np.repeat(fresh, np.diff(bounds))], np.concatenate([[0], np.cumsum(size)]).astype(np.int64), rule, deletions)
                for into, x in zip(held, (found[fresh], size, e.signature, 2 * (e.owner + n) + e.lower, e.less, e.part + made, e.plural), strict=True):
                    into.append(x)
                n, count, made = n + len(size), count + len(e.signature), made + len(e.signature)
                if count > HELD:
                    yield flush(held)
                    held, n, count, made = [[] for _ in range(7)], 0, 0, 0
        if count:
            yield flush(held)
        release()

    return source.mapInArrow(run, _ENTRIES + (_PARTS if deletions else ""))


def _facts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets in one of their cuts, ascending, and (size, parts, plural parts) of each."""
    key = np.frombuffer(b"".join(table.column("known").to_pylist()), np.uint64)
    facts = np.concatenate([np.zeros((3, 0), "<u4"), *(np.frombuffer(x, "<u4").reshape(3, -1) for x in table.column("facts").to_pylist())], axis=1)
    own, at = np.unique(key, return_index=True)
    return own, facts[:, at].astype(np.int64)


class _Buckets:
    """A target's entries that share their signatures, in the order of these:
    bucket number, key, whether of the next smaller band's cut, kind, part."""

    def __init__(self, table: pa.Table) -> None:
        c = {name: table.column(name).to_pylist() for name in table.column_names if name != "target"}
        told = _of_five(c["signatures"])
        sig, lower = told >> np.uint64(1), told & np.uint64(1)
        sets = [len(x) // 8 for x in c["keys"]]
        owner = np.repeat(np.arange(sum(sets)), _of_few(c["counts"], sets))
        kinds = np.frombuffer(b"".join(c["kinds"]), np.uint8) if "kinds" in c else np.zeros(len(sig), np.uint8)
        order = np.argsort(sig)
        same = sig[order][1:] == sig[order][:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        key, kind = np.frombuffer(b"".join(c["keys"]), np.uint64)[owner[order]] << np.uint64(1) | lower[order], kinds[order]
        # a set that several tasks sent counts once
        sort = np.lexsort((kind, key, sig[order]))
        order, key, kind = order[sort], key[sort], kind[sort]
        own = sig[order]
        if len(own):
            once = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
            order, key, kind, own = order[once], key[once], kind[once], own[once]
            number = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
        else:
            number = _NONE
        self.number, self.signature, self.kind, self.less = number, own, kind, kind > 1
        self.doubled, self.key, self.lower = key, key >> np.uint64(1), (key & np.uint64(1)).astype(bool)
        self.part = _of_few(c["part"], [len(x) // 5 for x in c["signatures"]])[order] if "part" in c else None

    def count(self, which: np.ndarray) -> np.ndarray:
        """How many of these entries each entry's bucket holds."""
        return np.bincount(self.number, weights=which)[self.number].astype(np.int64) if len(self.number) else _NONE


def _labels(spark: SparkSession) -> list[int]:
    """A number for each shuffle partition that Spark's hash puts there, so that
    each is one target and has about as much to do as any other."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: dict[int, int] = {}
    low = 0
    while len(found) < spread:
        rows = spark.range(low, low + 20 * spread, 1, 1).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(spread)).alias("p"))
        for r in rows.groupBy("p").agg(F.min("i").alias("i")).collect():  # one row a partition
            found.setdefault(r["p"], r["i"])
        low += 20 * spread
    return [found[p] for p in range(spread)]


def alive(source: DataFrame, rule: Rule) -> DataFrame:
    """Written table (k) of the sets that can be linked at all.

    Each of the at most h members by which two linked sets differ touches one
    part, so of a set's p parts at least p - h are the same in its partner.  A
    set of which fewer parts are met by any suitable set has no partner.
    """
    labels = _labels(source.sparkSession)
    targets = len(labels)

    def count(table: pa.Table) -> pa.Table:
        b = _Buckets(table)
        rows = [(table.column("target")[0].as_py(), b"", b"", b"", b"".join(table.column("known").to_pylist()), np.concatenate([np.frombuffer(x, "<u4").reshape(3, -1) for x in table.column("facts").to_pylist()], axis=1).tobytes())]
        if len(b.number):
            n_own, n_lower = b.count(~b.lower), b.count(b.lower)
            # met by a set of its own band; by a larger set that looks down; in the lower cut, by a smaller set
            found = [(k, *np.unique(b.doubled[hit], return_counts=True)) for k, hit in enumerate((~b.lower & (n_own > 1), ~b.lower & (n_lower > 0), b.lower & (n_own > 0)))]
            kind = np.concatenate([np.full(len(x), k, np.uint8) for k, x, _ in found])
            key, met = (np.concatenate([x[i] for x in found]) for i in (1, 2))
            order, shares = _dealt(_judge(key >> np.uint64(1), targets), targets)
            for t, x, y in shares:
                mine = order[x:y]
                rows.append((labels[t], key[mine].tobytes(), _few(met[mine]), kind[mine].tobytes(), b"", b""))
        release()
        return pa.table({n: pa.array(x, pa.binary() if i else pa.int32()) for i, (n, x) in enumerate(zip(("q", "keys", "met", "kinds", "known", "facts"), zip(*rows, strict=True), strict=True))})

    def judge(table: pa.Table) -> pa.Table:
        own, (size, parts, _) = _facts(table)
        raw = table.column("keys").to_pylist()
        key, kind, met = np.frombuffer(b"".join(raw), np.uint64), np.frombuffer(b"".join(table.column("kinds").to_pylist()), np.uint8), _of_few(table.column("met").to_pylist(), [len(x) // 8 for x in raw])
        at = np.searchsorted(own, key)
        tops = np.array(bands(rule, int(size.max()) if len(size) else 1), np.int64)
        band = np.searchsorted(tops, size)
        good = [np.zeros(0, np.uint64)]
        # the largest set that each kind of partner can be
        for k, reach in enumerate((tops[band], size * rule.den // rule.num, tops[np.maximum(band - 1, 0)])):
            hits = np.bincount(at[kind == k], weights=met[kind == k], minlength=len(own))
            good.append(own[(hits > 0) & (hits >= parts - rule.difference(size, reach))])
        return pa.table({"k": pa.array(np.unique(np.concatenate(good) >> np.uint64(1)).astype(np.int64), pa.int64())})

    # a fixed number of partitions: little data here is much work
    met = _packed(source, rule).repartition(targets, "target").groupBy("target").applyInArrow(count, "q int, keys binary, met binary, kinds binary, known binary, facts binary")
    return written(met.repartition(targets, "q").groupBy("q").applyInArrow(judge, "k long"), "alive")


def cheapest(owner: np.ndarray, part: np.ndarray, first: np.ndarray, second: np.ndarray, need: np.ndarray) -> np.ndarray:
    """How each part is looked up: not at all, as it is, or with its deletions
    (0, 1, 2), so that each owner's numbers sum to its need at least, and their
    costs are little.  ``first`` is the cost of a part as it is, ``second`` what
    its deletions add (infinite where it has none).  A part's second step is
    never taken before its first, so it is ranked by the dearer of both."""
    steps = np.concatenate([first, np.maximum(first, second)])
    whose, index = np.concatenate([owner, owner]), np.concatenate([np.arange(len(owner))] * 2)
    again = np.repeat([0, 1], len(owner))
    order = np.lexsort((again, np.concatenate([part, part]), steps, whose))
    start = np.flatnonzero(np.concatenate([[True], whose[order][1:] != whose[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    taken = order[(rank < need[whose[order]]) & np.isfinite(steps[order])]
    return np.bincount(index[taken], minlength=len(owner))


def weighed(source: DataFrame, rule: Rule) -> DataFrame:
    """The entries that are left when each set looks up its cheapest parts:
    (target, keys, signatures, flags), see ``_LOOKS``."""
    labels = _labels(source.sparkSession)
    targets = len(labels)

    def count(table: pa.Table) -> pa.Table:
        b = _Buckets(table)
        t = table.column("target")[0].as_py()
        rows = [(t, t, b"", b"", b"", b"", b"", b"", b"".join(table.column("known").to_pylist()), np.concatenate([np.frombuffer(x, "<u4").reshape(3, -1) for x in table.column("facts").to_pylist()], axis=1).tobytes())]
        if len(b.number):
            whole, less = b.count(~b.lower & ~b.less), b.count(~b.lower & b.less)
            # whom a look-up meets: a part meets parts, and with its deletions also others' parts less a member; less a member it meets parts
            plain = np.where(b.less, 0, whole - (~b.lower & ~b.less))
            more = np.where(b.less, whole, less)
            use = np.flatnonzero((plain + more > 0) | (~b.lower & (b.count(b.lower) > 0)))
            use = use[np.argsort(b.doubled[use], kind="stable")]
            order, shares = _dealt(_judge(b.key[use], targets), targets)
            for q, x, y in shares:
                mine = use[order[x:y]]
                keys, count = np.unique(b.doubled[mine], return_counts=True)
                costs = np.minimum(np.stack([plain[mine], more[mine]]), 0xFFFF)  # dearer ones are all as dear
                rows.append((labels[q], t, keys.tobytes(), _few(count), _five(b.signature[mine]).tobytes(), b.kind[mine].tobytes(), _few(b.part[mine]), costs.astype("<u2").tobytes(), b"", b""))
        names = ["q", "target", "keys", "counts", "signatures", "kinds", "part", "costs", "known", "facts"]
        release()
        return pa.table({c: pa.array(x, pa.int32() if i < 2 else pa.binary()) for i, (c, x) in enumerate(zip(names, zip(*rows, strict=True), strict=True))})

    def choose(table: pa.Table) -> pa.Table:
        c = {name: table.column(name).to_pylist() for name in table.column_names}
        own, (size, p, q) = _facts(table)
        sets, entries = [len(x) // 8 for x in c["keys"]], [len(x) // 5 for x in c["signatures"]]
        key = np.repeat(np.frombuffer(b"".join(c["keys"]), np.uint64), _of_few(c["counts"], sets))
        number = np.searchsorted(own, key)
        sig, kind = _of_five(c["signatures"]), np.frombuffer(b"".join(c["kinds"]), np.uint8)
        target, part = np.repeat(np.array(c["target"], np.int64), entries), _of_few(c["part"], entries)
        plain, more = np.concatenate([np.zeros((2, 0), "<u2"), *(np.frombuffer(x, "<u2").reshape(2, -1) for x in c["costs"])], axis=1).astype(np.int64)
        less, plural, lower = kind > 1, (kind & 1) > 0, (own & np.uint64(1)).astype(bool)
        if not len(own):
            return pa.table({n: pa.array([], pa.binary() if i else pa.int32()) for i, n in enumerate(("target", "keys", "signatures", "flags"))})
        tops = np.array(bands(rule, int(size.max())), np.int64)
        reach = np.where(lower, tops[np.maximum(np.searchsorted(tops, size) - 1, 0)], size)
        # the parts of which entries came; of the others nothing meets anybody, so they catch their differences for nothing
        piece, at_piece, back = np.unique(number * (int(part.max(initial=0)) + 1) + part, return_index=True, return_inverse=True)
        whose, has_two = number[at_piece], plural[at_piece]
        free = p - np.bincount(whose, minlength=len(own)) + q - np.bincount(whose, weights=has_two, minlength=len(own)).astype(np.int64)
        need = rule.difference(size, reach) + 1 - free
        cost, added = np.zeros(len(piece)), np.zeros(len(piece))
        np.add.at(cost, back, plain)
        np.add.at(added, back, more)
        step = cheapest(whose, piece, cost, np.where(has_two, added, np.inf), need)[back]
        flags = ((step > 0) & (plain > 0)).astype(np.uint8) | ((step > 1) & ~less & (more > 0)).astype(np.uint8) << 1
        flags |= ((step > 1) & less & (more > 0)).astype(np.uint8) | less.astype(np.uint8) << 2
        keep = (flags & 3 > 0) | ~lower[number]
        rows: list[list] = [[], [], [], []]
        here = np.searchsorted(numbered, target[keep])
        order, shares = _dealt(here, targets)
        which = np.flatnonzero(keep)[order]
        for t, x, y in shares:
            mine = which[x:y]
            for into, v in zip(rows, (int(numbered[t]), key[mine].tobytes(), _five(sig[mine]).tobytes(), flags[mine].tobytes()), strict=True):
                into.append(v)
        release()
        return pa.table({n: pa.array(x, pa.binary() if i else pa.int32()) for i, (n, x) in enumerate(zip(("target", "keys", "signatures", "flags"), rows, strict=True))})

    numbered = np.sort(np.array(labels, np.int64))
    counted = _packed(source, rule, deletions=True).repartition(targets, "target").groupBy("target")
    counted = counted.applyInArrow(count, "q int, target int, keys binary, counts binary, signatures binary, kinds binary, part binary, costs binary, known binary, facts binary")
    return counted.repartition(targets, "q").groupBy("q").applyInArrow(choose, "target int, keys binary, signatures binary, flags binary")


def met(chosen: DataFrame) -> DataFrame:
    """Written table (a, b, n, looks, needed): each member a of the buckets that
    somebody looks up, with the bucket's first set b; in how many buckets, whether
    a looks any of them up, and whether one of the two does."""
    def find(table: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        sig = _of_five(table.column("signatures").to_pylist())
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)
        key, lower, less = key >> np.uint64(1), (key & np.uint64(1)).astype(bool), flags > 3
        found = [[np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)] * 2]
        # a bucket of parts, and one of parts less a member
        for in_it, looks in ((~lower & ~less, (flags & 1) > 0), (~lower & less, (flags & 2) > 0)):
            some = np.flatnonzero(in_it | looks)
            some = some[np.lexsort((~looks[some], key[some], sig[some]))]
            s, k, look = sig[some], key[some], looks[some]
            if not len(some):
                continue
            once = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
            s, k, look = s[once], k[once], look[once]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(first, len(s)))
            good = np.repeat((size > 1) & (np.add.reduceat(look.astype(np.int64), first) > 0), size)
            lead = np.repeat(first, size)
            good &= np.arange(len(s)) != lead
            found.append([k[good], k[lead][good], look[good], (look | look[lead])[good]])
        a, b, look, need = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b, look, need = a[order], b[order], look[order], need[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(a)))
        some = lambda x: np.add.reduceat(x.astype(np.int64), new) > 0 if len(new) else x[:0]
        release()
        return pa.table({"a": a[new].astype(np.int64), "b": b[new].astype(np.int64), "n": n, "looks": some(look), "needed": some(need)})

    spread = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chosen.repartition(spread, "target").groupBy("target").applyInArrow(find, "a long, b long, n long, looks boolean, needed boolean")
    return written(rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("looks").alias("looks"), F.max("needed").alias("needed")), "met")


# ---- verification -----------------------------------------------------------


def _wanted(ids: DataFrame) -> np.ndarray:
    """Bit filter of the set keys of a table; others may pass it, one of 400 at
    most up to 64 million keys.  It has 16 to 32 bits a key (16 KB to 128 MB),
    and steers costs only: a set more is stored."""
    bits = 1 << min(30, max(17, (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for byte, bit in _places(batch.column(0).to_numpy().astype(np.uint64), bits):
                np.bitwise_or.at(out, byte, np.uint8(1) << bit)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():  # 4 rows
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def verify(source: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Written table of the pairs (a, b) of set keys that are linked, by exact intersection."""

    def check(group: pa.Table) -> pa.Table:
        centre = group.column("b")[0].as_py()
        found = dict(zip(group.column("k").to_pylist(), group.column("grams").to_pylist(), strict=True))
        own = np.frombuffer(found.pop(centre), np.uint64)
        good = []
        for k, raw in found.items():
            other = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            if rule.linked(np.int64((own[at] == other).sum()), len(own), len(other)):
                good.append(k)
        return pa.table({"a": pa.array(good, pa.int64()), "b": pa.array([centre] * len(good), pa.int64())})

    # a large group is dealt into shares, and its centre to all of them
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = pairs.select("a", "b").join(shares, "b")
    members = dealt.select(F.col("a").alias("k"), "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    centres = shares.select(F.col("b").alias("k"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    sent = source.join(members.union(centres).hint("merge"), "k").select("b", "share", "k", "grams")
    out = written(sent.groupBy("b", "share").applyInArrow(check, "a long, b long"), "links")
    collect_garbage(source.sparkSession)  # all stored sets were dealt out for it; the next step deals them again
    return out


def common_of(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many n-grams each of the sets numbered x has in common with each of those numbered y."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    g, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    held = np.diff(np.append(first, len(g)))
    out = np.zeros((n, n), np.int32)
    # n-grams that a few sets hold: the pairs of their holders are counted
    few = max(2, n // 8)
    pairs: list[np.ndarray] = []
    size = 0

    def settle() -> None:
        nonlocal out, size
        if pairs:
            out += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n).astype(np.int32)
        pairs.clear()
        size = 0

    for m in np.unique(held[(held > 1) & (held <= few)]).tolist():
        i, j = np.triu_indices(m, 1)
        mine = first[held == m]
        step = max(1, 1_000_000 // len(i))
        for low in range(0, len(mine), step):
            who = owner[mine[low : low + step, None] + np.arange(m)]
            pairs.append((who[:, i] * n + who[:, j]).reshape(-1))
            size += len(pairs[-1])
            if size > 4_000_000:
                settle()
    settle()
    out += out.T
    # n-grams that many hold: a product of matrices, some at a time
    many = held > few
    number = np.repeat(np.cumsum(many) - 1, held)[there := np.repeat(many, held)]
    owner = owner[there]
    found = out[np.ix_(x, y)].astype(np.int64)
    for low in range(0, int(many.sum()), WIDTH):
        a, b = np.searchsorted(number, [low, low + WIDTH])
        holds = np.zeros((n, min(WIDTH, int(many.sum()) - low)), np.float32)
        holds[owner[a:b], number[a:b] - low] = 1
        found += (holds[x] @ holds[y].T).astype(np.int64)
    return found


def compared(source: DataFrame, members: DataFrame, rule: Rule, work, schema: str) -> DataFrame:
    """``work(linked, rows, x, y, same)`` for the sets of each group, some at a time:
    ``linked`` tells which of the rows numbered x are linked with which of those
    numbered y; ``rows`` holds the members' columns.

    ``members`` has columns k (a set's key), g (its group), size, looks, and more.
    Sets that look are compared with all of their group, the others with those
    only.  A group is dealt into shares of about SHARE sets or GRAMS n-grams, and
    each pair of its shares is one task's, so no task holds a whole large group.
    """
    shares = lambda which: F.ceil(F.greatest(F.sum(which.cast("long")) / SHARE, F.sum(F.when(which, F.col("size")).otherwise(0)) / GRAMS)).cast("int")
    counted = members.groupBy("g").agg(shares(F.lit(True)).alias("_all"), shares(F.col("looks")).alias("_lookers"), shares(~F.col("looks")).alias("_others"))
    # a group that fits into one share is one
    alone = F.col("_all") == 1
    counted = counted.select("g", alone.alias("_alone"), F.when(alone, 1).otherwise(F.col("_lookers")).alias("_lookers"), F.when(alone, 0).otherwise(F.col("_others")).alias("_others"))
    own = members.join(counted, "g").withColumn("_looks", F.col("_alone") | F.col("looks"))
    number = F.xxhash64("k")
    own = own.withColumn("_own", F.when(F.col("_looks"), F.pmod(number, F.greatest("_lookers", F.lit(1)))).otherwise(F.col("_lookers") + F.pmod(number, F.greatest("_others", F.lit(1)))).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("_looks"), F.col("_lookers") + F.col("_others")).otherwise(F.col("_lookers")) - 1)))
    dealt = own.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_alone", "_looks", "_lookers", "_others", "_other")

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        second = group.column("_own").to_numpy() != group.column("_i").to_numpy()
        same = group.column("_i")[0].as_py() == group.column("_j")[0].as_py()
        x, y = (np.arange(len(sets)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        linked = rule.linked(common_of(sets, x, y), size[x][:, None], size[y][None, :])
        if same:
            np.fill_diagonal(linked, False)
        return work(linked, group, x, y, same)

    sent = source.join(dealt.hint("merge"), "k")
    return sent.groupBy("g", "_i", "_j").applyInArrow(run, schema)


def _join_labels(linked: np.ndarray, group: pa.Table, x: np.ndarray, y: np.ndarray, same: bool) -> pa.Table:
    """Links that join different labels, no more than it takes."""
    label = group.column("label").to_numpy()
    i, j = np.nonzero(linked)
    a, b = label[x[i]], label[y[j]]
    a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    out = []
    for u, v in pairs.tolist():
        p, q = find(u), find(v)
        if p != q:
            root[p] = q
            out.append((u, v))
    return pa.table({"a": pa.array([u for u, _ in out], pa.int64()), "b": pa.array([v for _, v in out], pa.int64())})


def _count_links(linked: np.ndarray, group: pa.Table, x: np.ndarray, y: np.ndarray, same: bool) -> pa.Table:
    """Weights of the sets that each set is linked with, summed."""
    weight = group.column("weight").to_numpy().astype(np.int64)
    out = np.zeros(len(weight), np.int64)
    out[x] += linked @ weight[y]
    if not same:
        out[y] += weight[x] @ linked
    return pa.table({"k": group.column("k"), "n": pa.array(out, pa.int64())})


# ---- the operator -----------------------------------------------------------


def _classed(docs: DataFrame, rule: Rule, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(key, n_shingles, component_id, set_key, class) of every row; the sets that
    can be linked; the components (id, label) of those that are; (set_key, size,
    weight) of all sets."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    nodes = written(sets(docs, rule, key, text), "nodes")
    weights = written(nodes.where("set_key is not null").groupBy("set_key").agg(F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("weight")), "weights")
    # who can be linked at all; of those who are left, whom the cheapest look-ups meet
    wanted = _wanted(alive(texts(docs, text=text), rule))
    collect_garbage(spark)  # the largest shuffle of all is done with
    store = stored(docs, rule, wanted, text)
    collect_garbage(spark)
    found = met(weighed(store, rule))
    collect_garbage(spark)
    sized = found
    for c in ("a", "b"):
        sized = sized.join(weights.select(F.col("set_key").alias(c), F.col("size").alias(f"n_{c}")), c)
    close = sized.where(F.col("needed") & (rule.num * F.greatest("n_a", "n_b") <= rule.den * F.least("n_a", "n_b")))
    pairs = written(close.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).select("a", "b", "rank"), "pairs")
    # first each set with the leader that it meets most, then with the others, as far as these are in other components
    links = verify(store, pairs.where("rank = 1"), rule)
    label = written(components(links), "labels")

    def named(df: DataFrame, c: str) -> DataFrame:
        own = label.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
        return df.join(own, c, "left").withColumn(f"l_{c}", F.coalesce(f"l_{c}", c))

    apart = written(named(named(pairs.where("rank > 1").select("a", "b"), "a"), "b").where("l_a <> l_b").select("a", "b"), "apart")
    if apart.limit(1).count():
        links = links.union(verify(store, apart, rule))
        label = written(components(links), "labels")
    # members of one leader that are still in different components, if one of them looks
    group = named(found.select("a", "b", "looks"), "a").withColumnRenamed("l_a", "label")
    still = group.groupBy("b").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("looks").alias("some")).where("low <> high and some").select("b")
    group = group.join(still, "b", "left_semi").join(weights.select(F.col("set_key").alias("a"), "size"), "a")
    group = written(group.select(F.col("a").alias("k"), F.col("b").alias("g"), "size", "looks", "label"), "groups")
    if group.limit(1).count():
        more = written(compared(store, group, rule, _join_labels, "a long, b long"), "links")
        collect_garbage(spark)
        links = links.union(more)
        label = written(components(links), "labels")
    named_nodes = nodes.join(label.withColumnRenamed("id", "set_key"), "set_key", "left").withColumn("class", F.coalesce("label", "set_key")).drop("label")
    least = named_nodes.where("class is not null").groupBy("class").agg(F.min(f"`{key}`").alias("_least"))
    whole = named_nodes.join(least, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col(f"`{key}`")).otherwise(F.col("_least")))
    return whole.select(f"`{key}`", "n_shingles", "component_id", "set_key", "class"), store, label, weights


def classes(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    return _classed(docs, rule, key, text)[0].drop("set_key", "class")


def linked_classes(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row; n_links counts the
    other rows that the row is linked to, equal sets among them."""
    found, store, label, weights = _classed(docs, rule, key, text)
    members = label.withColumnRenamed("id", "set_key").join(weights, "set_key")
    members = members.select(F.col("set_key").alias("k"), F.col("label").alias("g"), "size", F.lit(True).alias("looks"), "weight")
    counted = compared(store, members, rule, _count_links, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).withColumnRenamed("k", "set_key")
    out = found.join(weights.drop("size"), "set_key", "left").join(counted, "set_key", "left")
    return out.select(f"`{key}`", "n_shingles", "component_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))


def _keyed(docs: DataFrame, rule: Rule, text: str, name: str) -> DataFrame:
    """The documents with their set's key in a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
            found = np.concatenate([np.zeros(0, np.uint64), *(keys_of(grams, bounds) for _, grams, bounds in shingles(column, rule))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=found == 0)], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("long")).schema)


def one_of_each(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, but one row of each class: that of
    the smallest id (one of them, where several rows of the class have it); rows
    of the empty set stay."""
    found = _classed(docs, rule, key, text)[0].select(F.col(f"`{key}`").alias("_key"), "set_key", "class")
    found = written(found, "classes")
    kept = found.where("class is not null").groupBy("class").agg(F.min_by(F.struct("_key", "set_key"), F.struct(F.col("_key").isNull(), "_key", "set_key")).alias("k")).select("k.*")
    kept = written(kept, "kept")
    # ids of which every row goes, and ids (or none) of which some rows may stay and others go
    rows = found.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.count("set_key").alias("full"))
    some = kept.groupBy("_key").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.join(some, rows["_key"].eqNullSafe(some["_key"]), "left").select(rows["_key"], "n", "full", F.coalesce("m", F.lit(0)).alias("m"))
    rows = written(rows.where("n > 1 or _key is null or (full > 0 and m = 0)").withColumn("gone", F.expr("full = n and m = 0 and _key is not null")), "rows")
    name, k, s = (unused(docs, c) for c in ("_set_key", "_k", "_s"))
    same = F.col(f"`{key}`").eqNullSafe(F.col(f"`{k}`"))
    out = docs.join(rows.select(F.col("_key").alias(k)), same, "left_anti")
    odd = rows.where("not gone").select(F.col("_key").alias(k))
    if odd.limit(1).count():
        several = docs.join(odd, same, "left_semi")
        several = _keyed(several.withColumn(text, F.col(f"`{text}`").cast("string")), rule, text, name)
        mine = kept.select(F.col("_key").alias(k), F.col("set_key").alias(s))
        good = several.join(mine, same & (F.col(f"`{name}`") == F.col(f"`{s}`")), "left_semi").dropDuplicates([key, name])
        out = out.unionByName(good.drop(name)).unionByName(several.where(F.col(f"`{name}`").isNull()).drop(name))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
