"""Suffix-array deduplication: bytes inside a string of ``length`` bytes that
also starts anywhere else are removed; strings do not cross documents.

1. Documents are packed into blocks, the record batches of Arrow files in the
   shared folder.  What Spark moves from here on is numbers and bits, and the
   bytes of step 3; a block is read where it lies.
2. Every window of ``length`` bytes names its anchor, the least hash among its
   substrings of ``GRAM`` bytes (leftmost of equals), which depends on the
   window's bytes only.  Windows of one anchor follow each other; they are a
   run, and the bytes under a run are its segment.  Each block sends the hashes
   of its distinct (anchor, segment).  An anchor that occurs once in all
   documents cannot belong to a repeated window; where all segments of an
   anchor that occurs again are equal, all their windows are repeated.
3. Anchors with different segments send them, each distinct one once a block.
   They are suffix-sorted in two stages (``suffixes``), and adjacent common
   prefixes of ``length`` bytes tell the repeated windows.  Of anchors with
   very many different segments (a passage that stands in many documents, each
   time between other words) the runs are first split into ``SPLIT`` by where
   the anchor stands in the window, and each is named by the bytes that all its
   windows have in common, so one passage's windows are dealt to many tasks.
4. A bit for each window goes back to its block, where the covered bytes go.

Segments are told apart by 64-bit hashes within their anchor's.

Defined results: null and empty texts, and texts shorter than the length, lose
nothing; equal documents of at least that length lose every byte, all of them
(also the first); overlapping repeats count; texts of any length are judged
whole; rows with null ids or the same id are documents of their own; extra
columns are ignored by ``spans`` and kept by ``remove``; an empty table gives
an empty result.  The length must be that of an anchor at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm import kernels as K
from tetrad.llm.shared import blocks, folder_files, new_folder, release, small_batches, text_bytes, texts, written
from tetrad.llm.suffixes import repeated_windows

GRAM = 64
#: Bytes of text in a block (longer documents are blocks of their own), of blocks in a file, and of text for one target.
BLOCK, FILE, SHARE = 3 << 19, 256 << 20, 16 << 20
#: Different segments of an anchor beyond which its runs are split, and into how many.
MANY, SPLIT = 1000, 8
#: Bytes of segments that are sorted together, about; one anchor's are never parted.
SORTED = 1 << 19
#: What is known of an anchor: it occurs once; its segments are equal; they differ; very many differ.
ONCE, EQUAL, DIFFER, MANIFOLD = range(4)
_PLACE = np.uint64((1 << 31) - 1)
_NONE = np.zeros(0, np.int64)


# ---- blocks -----------------------------------------------------------------


def _pack(docs: DataFrame) -> tuple[str, DataFrame]:
    """The folder, and a written table (file, number, size) of the blocks in it."""
    folder = new_folder(docs.sparkSession, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = folder_files(folder)
        fs.create_dir(base, recursive=True)
        held: list[pa.RecordBatch] = []
        size = total = number = 0
        name, sink, out = "", None, None

        def flush() -> pa.RecordBatch:
            nonlocal size, total, number, name, sink, out
            if out is None:
                name, number, total = f"{uuid.uuid4().hex}.arrow", 0, 0
                sink = fs.open_output_stream(f"{base}/{name}")
                out = pa.ipc.new_file(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([size], pa.int64())], ["file", "number", "size"])
            total, number, size = total + size, number + 1, 0
            held.clear()
            if total > FILE:
                out.close()
                sink.close()
                out = None
            return row

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a batch may hold many blocks
                rows = 1
                while at + rows < batch.num_rows and batch.slice(at, 2 * rows).nbytes + size < BLOCK:
                    rows *= 2
                held.append(batch.slice(at, rows))
                at, size = at + rows, size + held[-1].nbytes
                if size > BLOCK:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()
            sink.close()
        release()

    return folder, written(docs.mapInArrow(run, "file string, number long, size long"), "block-list")


def _reader(folder: str) -> Callable[[str, int], pa.RecordBatch]:
    """A function that reads a block of the folder."""
    fs, base = folder_files(folder)
    now, file = "", None

    def read(name: str, number: int) -> pa.RecordBatch:
        nonlocal now, file
        if name != now:
            now, file = name, pa.ipc.open_file(fs.open_input_file(f"{base}/{name}"))
        return file.get_batch(number)

    return read


# ---- anchors and runs -------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place: the 8 bytes from each place,
    mixed, are summed over 8 places 8 bytes apart, each with a factor of its own."""
    n = len(data) - 7
    total = np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    total *= K.FACTORS[0]
    total ^= total >> np.uint64(32)
    total *= K.FACTORS[1]
    total ^= total >> np.uint64(29)
    for k, step in enumerate((8, 16, 32)):
        total = total[:-step] + total[step:] * K.FACTORS[2 + k]
    return K.mix(total)


def _span_hash(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of spans of at least GRAM bytes, from the hashes of their GRAMs."""
    out = K.mix(grams[starts + sizes - GRAM] + sizes.astype(np.uint64))
    k = 0
    while len(at := np.flatnonzero(sizes > GRAM * (k + 1))):
        out[at] += grams[starts[at] + GRAM * k] * K.factors(k + 1)[k]
        k += 1
    return K.mix(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """The runs of a block: first and last window, anchor, key (the anchor's
    hash) and segment (its hash), in order of their places."""

    def __init__(self, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, key: np.ndarray, segment: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.key, self.segment = first, last, anchor, key, segment

    def __getitem__(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in (self.first, self.last, self.anchor, self.key, self.segment)))

    def __add__(self, other: Runs) -> Runs:
        return Runs(*(np.concatenate([x, y]) for x, y in zip(vars(self).values(), vars(other).values(), strict=True)))

    def __len__(self) -> int:
        return len(self.first)


_NO_RUNS = Runs(_NONE, _NONE, _NONE, np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Runs:
    """All runs of a block's documents."""
    out = [_NO_RUNS]
    for a, b in blocks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo < length:
            continue
        grams = _grams(data[lo:hi])
        least = _sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
        anchor = (least & _PLACE).astype(np.int64)
        ends = offsets[a + 1 : b + 1] - lo
        sizes = np.diff(offsets[a : b + 1])
        # windows that lie within one document
        stop = np.maximum(ends - length + 1, ends - sizes)
        edge = np.zeros(hi - lo + 1, np.int64)
        np.add.at(edge, ends - sizes, 1)
        np.add.at(edge, stop, -1)
        at = np.flatnonzero(np.cumsum(edge[: len(anchor)]) > 0)
        if not len(at):
            continue
        own = anchor[at]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(first[1:], len(at)) - 1
        i, j, k = at[first], at[last], own[first]
        # mixed anew: a least hash is a small number
        out.append(Runs(i + lo, j + lo, k + lo, K.mix(grams[k] + np.uint64(1)), _span_hash(grams, i, j - i + length)))
    whole = out[0]
    for x in out[1:]:
        whole = whole + x
    return whole


def split(data: np.ndarray, runs: Runs, length: int) -> Runs:
    """The runs cut by where the anchor stands in the window: windows whose
    anchors begin ``d`` bytes behind their own beginnings, by d // width.  The
    windows of a cut have all but width - 1 of their bytes in common, from the
    anchor less the cut's least d; those bytes name it."""
    if not len(runs):
        return runs
    grams, width = _grams(data), -(-(length - GRAM + 1) // SPLIT)
    out = _NO_RUNS
    for k in range(SPLIT):
        i, j = np.maximum(runs.first, runs.anchor - width * (k + 1) + 1), np.minimum(runs.last, runs.anchor - width * k)
        some = np.flatnonzero(i <= j)
        i, j, a = i[some], j[some], runs.anchor[some]
        common = np.full(len(some), length - width + 1, np.int64)
        key = K.mix(_span_hash(grams, a - width * k, common) + np.uint64(k + 1))
        out = out + Runs(i, j, a, key, _span_hash(grams, i, j - i + length))
    return out


def _target(key: np.ndarray, targets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)


class Distinct:
    """A block's distinct (key, segment) in order of their targets: ``chosen``,
    a run that has each; ``number``, which of them each run has; ``often``,
    whether it occurs twice or more; ``shares``, (target, from, to)."""

    def __init__(self, runs: Runs, targets: int) -> None:
        target = _target(runs.key, targets).astype(np.int64)
        order = np.lexsort((runs.segment, runs.key, target))
        k, s = runs.key[order], runs.segment[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(order) else np.zeros(0, bool)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.chosen = order[new]
        self.often = np.bincount(self.number, minlength=len(self.chosen)) > 1
        own, at = np.unique(target[self.chosen], return_index=True)
        bounds = [*at.tolist(), len(self.chosen)]
        self.shares = list(zip(own.tolist(), bounds, bounds[1:], strict=False))


# ---- what is known of the anchors -------------------------------------------


def _listed(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _bytes_of(rows: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(rows.column(text).cast(pa.large_string()).fill_null(""))


def _known(listed: DataFrame, folder: str, text: str, length: int, targets: int, tasks: int) -> DataFrame:
    """(file, number, known by target): what is known of each block's distinct (key, segment)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            for file, number in _listed(batch, "file", "number"):
                own = runs(*_bytes_of(read(file, number), text), length)
                found = Distinct(own, targets)
                # the key's lower 40 bits and the target stand for it; the segment's lowest bit tells that it occurs again in its own block
                key = np.ascontiguousarray(own.key[found.chosen].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                segment = (own.segment[found.chosen] & ~np.uint64(1)) | found.often.astype(np.uint64)
                n = len(found.shares)
                columns = [[t for t, _, _ in found.shares], [file] * n, [number] * n, [key[a:b].tobytes() for _, a, b in found.shares], [segment[a:b].tobytes() for _, a, b in found.shares]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["target", "file", "number", "keys", "segments"])
        release()

    def judge(table: pa.Table) -> pa.Table:
        raw = table.column("keys").to_pylist()
        key = np.zeros((sum(map(len, raw)) // 5, 8), np.uint8)
        key[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
        key = key.view("<u8").reshape(-1)
        segment = np.frombuffer(b"".join(table.column("segments").to_pylist()), np.uint64)
        order = np.lexsort((segment, key))
        k, s = key[order], segment[order] >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        again = (size > 1) | (np.add.reduceat(segment[order] & np.uint64(1), first) > 0)
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        different = np.add.reduceat(new.astype(np.int64), first)
        state = np.where(~again, ONCE, np.where(different == 1, EQUAL, np.where(different <= MANY, DIFFER, MANIFOLD))).astype(np.uint8)
        out = np.empty(len(k), np.uint8)
        out[order] = np.repeat(state, size)
        cut = np.cumsum([0, *(len(x) // 5 for x in raw)]).tolist()
        release()
        return pa.table({c: table.column(c) for c in ("file", "number", "target")} | {"known": pa.array([out[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    sent = listed.mapInArrow(send, "target long, file string, number long, keys binary, segments binary")
    small = sent.repartition(tasks, "target").groupBy("target").applyInArrow(judge, "file string, number long, target long, known binary")
    return written(small.groupBy("file", "number").agg(F.collect_list(F.struct("target", "known")).alias("known")), "anchors")


def _states(own: Runs, known: list[dict], targets: int) -> np.ndarray:
    """What is known of each run's anchor."""
    found = Distinct(own, targets)
    of = {x["target"]: x["known"] for x in known or ()}
    state = np.zeros(len(found.chosen), np.uint8)
    for t, a, b in found.shares:
        state[a:b] = np.frombuffer(of[t], np.uint8)
    return state[found.number]


def _to_sort(data: np.ndarray, own: Runs, state: np.ndarray, length: int) -> Runs:
    """The runs whose segments differ from others of their anchors'."""
    return own[state == DIFFER] + split(data, own[state == MANIFOLD], length)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all these ranges in a row."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _sorted(listed: DataFrame, folder: str, text: str, length: int, targets: int, tasks: int) -> DataFrame:
    """(file, number, judged by target): a bit for each window of each block's
    distinct segments that differ from others of their anchors'."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            for file, number, known in _listed(batch, "file", "number", "known"):
                data, offsets = _bytes_of(read(file, number), text)
                own = runs(data, offsets, length)
                own = _to_sort(data, own, _states(own, known, targets), length)
                found = Distinct(own, targets)
                out: list[list] = [[], [], [], [], [], [], [], []]
                for t, a, b in found.shares:
                    mine = found.chosen[a:b]
                    sizes = own.last[mine] + length - own.first[mine]
                    values = (t, file, number, own.key[mine].tobytes(), own.segment[mine].tobytes(), sizes.astype("<u4").tobytes(), found.often[a:b].tobytes())
                    for into, v in zip(out, (*values, pa.compress(data[_spread(own.first[mine], sizes)].tobytes(), codec="zstd", asbytes=True)), strict=True):
                        into.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["target", "file", "number", "keys", "segments", "sizes", "often", "bytes"])
        release()

    def judge(table: pa.Table) -> pa.Table:
        joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        key, segment, often, size_of = joined("keys", np.uint64), joined("segments", np.uint64), joined("often", bool), table.column("sizes").to_pylist()
        sizes = joined("sizes", "<u4").astype(np.int64)
        # equal segments are one; all windows of one that came more than once are repeated
        order = np.lexsort((segment, key))
        k, s = key[order], segment[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        chosen = order[new]
        several = (np.bincount(number) > 1) | (np.bincount(number, weights=often) > 0)
        # the chosen segments' bytes, in the order of the rows that sent them
        place = np.full(len(order), -1, np.int64)
        row, held, at = 0, [], 0
        wanted = np.zeros(len(order), bool)
        wanted[chosen] = True
        for x, raw in zip(size_of, table.column("bytes").to_pylist(), strict=True):
            n = len(x) // 4
            own = sizes[row : row + n]
            part = np.frombuffer(pa.decompress(raw, decompressed_size=int(own.sum()), codec="zstd", asbytes=True), np.uint8)
            mine = np.flatnonzero(wanted[row : row + n])
            held.append(part[_spread((np.cumsum(own) - own)[mine], own[mine])])
            place[row + mine] = at + np.cumsum(own[mine]) - own[mine]
            at += len(held[-1])
            row += n
        data = np.concatenate(held)
        del held
        k = key[chosen]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.append(first[1:], len(k))
        windows = sizes[chosen] - length + 1
        bounds = np.concatenate([[0], np.cumsum(windows)])
        hit = np.repeat(several, windows)
        ends = np.cumsum(sizes[chosen])
        i = 0
        while i < len(first):
            # whole anchors together, as many as make a good array
            j = max(i + 1, int(np.searchsorted(ends[last - 1], (ends[first[i] - 1] if first[i] else 0) + SORTED, "right")))
            mine = np.arange(first[i], last[j - 1])
            mine = mine[np.repeat((last - first)[i:j] > 1, (last - first)[i:j])]
            i = j
            if not len(mine):
                continue
            sz, w = sizes[chosen[mine]], windows[mine]
            to = _spread(bounds[mine], w)
            hit[to] |= repeated_windows(data[_spread(place[chosen[mine]], sz)], _spread(np.cumsum(sz) - sz, w), length)
        # back to the blocks, in the order in which they sent their segments
        out, row = [], 0
        for x in size_of:
            mine = number[row : row + len(x) // 4]
            out.append(np.packbits(hit[_spread(bounds[mine], windows[mine])]).tobytes())
            row += len(mine)
        found = pa.table({c: table.column(c) for c in ("file", "number", "target")} | {"bits": pa.array(out, pa.binary())})
        return found

    sent = listed.mapInArrow(send, "target long, file string, number long, keys binary, segments binary, sizes binary, often binary, bytes binary")
    judged = sent.repartition(tasks, "target").groupBy("target").applyInArrow(judge, "file string, number long, target long, bits binary")
    return written(judged.groupBy("file", "number").agg(F.collect_list(F.struct("target", "bits")).alias("judged")), "windows")


# ---- the operator -----------------------------------------------------------


def _covered(rows: pa.RecordBatch, text: str, known: list[dict], judged: list[dict], length: int, targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, and whether each byte is removed."""
    data, offsets = _bytes_of(rows, text)
    own = runs(data, offsets, length)
    gone = np.zeros(len(data) + 1, np.int64)
    if len(own):
        state = _states(own, known, targets)
        same = own[state == EQUAL]
        gone += np.bincount(same.first, minlength=len(gone))
        gone -= np.bincount(same.last + length, minlength=len(gone))
        own = _to_sort(data, own, state, length)
        found = Distinct(own, targets)
        windows = (own.last - own.first + 1)[found.chosen]
        bounds = np.concatenate([[0], np.cumsum(windows)])
        hit = np.zeros(int(bounds[-1]), bool)
        of = {x["target"]: x["bits"] for x in judged or ()}
        for t, a, b in found.shares:
            hit[bounds[a] : bounds[b]] = np.unpackbits(np.frombuffer(of[t], np.uint8))[: bounds[b] - bounds[a]].astype(bool)
        w = windows[found.number]
        starts = _spread(own.first, w)[hit[_spread(bounds[found.number], w)]]
        gone += np.bincount(starts, minlength=len(gone))
        gone -= np.bincount(starts + length, minlength=len(gone))
    return data, offsets, np.cumsum(gone[:-1]) > 0


def _tables(docs: DataFrame, text: str, length: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple]]]:
    """Blocks with what is known of their windows, and a function that gives, of
    a batch of them, each block's rows, bytes, offsets and which bytes go."""
    if length < GRAM:
        raise ValueError(f"strings must have {GRAM} bytes at least")
    spark = docs.sparkSession
    small_batches(spark)
    folder, listed = _pack(docs)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = listed.agg(F.sum("size")).first()[0] or 0
    targets = max(2 * spread, -(-total // SHARE))
    # a fixed number of partitions, so that little data with much work is not put together
    dealt = lambda df: df.repartition(spread, "file", "number")
    listed = dealt(listed.select("file", "number"))
    known = _known(listed, folder, text, length, targets, spread)
    judged = _sorted(dealt(known), folder, text, length, targets, spread)
    whole = dealt(listed.join(known, ["file", "number"], "left").join(judged, ["file", "number"], "left"))

    def cover(batch: pa.RecordBatch) -> Iterator[tuple]:
        read = _reader(folder)
        for file, number, known, judged in _listed(batch, "file", "number", "known", "judged"):
            rows = read(file, number)
            yield rows, *_covered(rows, text, known, judged, length, targets)

    return whole, cover


def spans(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    source = texts(docs, key, text=text)
    known, cover = _tables(source, "text", length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, data, offsets, gone in cover(batch):
                n = len(offsets) - 1
                before = np.concatenate([[0], np.cumsum(gone)])
                removed = before[offsets[1:]] - before[offsets[:-1]]
                starts, _ = K.spans(gone, offsets)
                count = np.bincount(K.owners(starts, offsets), minlength=n)
                digests = []
                for i in range(n):
                    a, b = offsets[i], offsets[i + 1]
                    digests.append(hashlib.sha256(data[a:b][~gone[a:b]] if removed[i] else data[a:b]).hexdigest())
                yield pa.RecordBatch.from_arrays([docs.column(key), pa.array(np.diff(offsets)), pa.array(removed), pa.array(count.astype(np.int64)), pa.array(digests, pa.string())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = source.schema[key].dataType.simpleString()
    return known.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = 200, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with all their columns and the text that is left.

    A character that loses one of its bytes goes; ``n_chars``, where the table
    has it, becomes the length of what is left.
    """
    whole = docs.withColumn(text, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    counted = n_chars if n_chars in docs.columns else None
    known, cover = _tables(whole, text, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, data, offsets, gone in cover(batch):
                left = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                at = docs.schema.get_field_index(text)
                docs = docs.set_column(at, docs.schema.field(at).name, pa.array(left, docs.schema.field(at).type))
                if counted:
                    at = docs.schema.get_field_index(counted)
                    docs = docs.set_column(at, counted, pa.array([len(t) for t in left], pa.int64()).cast(docs.schema.field(at).type))
                yield docs

    return known.mapInArrow(run, whole.schema)
