"""Token ids of whole texts by a public tokenizer, and an Arrow file format for them.

``Encoder`` gives exactly the ids of the ``tokenizers`` library.  A text is cut
only where no token can reach across (see ``Encoder``), and the ids of each
distinct chunk are asked of the library once and remembered.

``write_sequences`` stores ids in Arrow IPC files of record batches with
fixed-size-list columns: equal-length sequences with their masks, so a reader
maps a file and takes any sequence without copying.  Texts stand in ascending
key order over the files in order of their number.

Defined results: null and empty texts have the end id alone; texts of any
length are encoded whole; repeated rows are stored as often as they come, in a
stable order (key, then text); rows with a null key come first; extra columns
are ignored; an empty table gives an empty result and no file.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetrad.llm import kernels as K
from tetrad.llm.shared import blocks, folder_files, new_folder, release, small_batches, text_bytes, texts, written

#: Bytes that make a text go whole to the library: control characters that libraries class differently.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]] = True
#: White space and format characters beyond ASCII, for which the same is true.
_ODD_WIDE = re.compile("[\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Punctuation before which a text is cut if a letter or digit stands before it; a bar may be part of a special token's spelling.
_POINT = np.zeros(256, bool)
_POINT[[c for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)) if c != 0x7C]] = True
#: The first k bytes of a little-endian number of 8.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Slots of a process's table of chunks, chunks that it holds besides, and their ids; beyond them, it forgets and begins anew.
SLOTS, BESIDES, POOL = 1 << 21, 1 << 16, 1 << 22


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by the tokenizer file.

    A text is cut where white space begins, and before punctuation that follows
    an ASCII letter or digit.  Both kinds of pre-tokenizer (byte-level, and
    words without white space) cut there whatever stands around, so the ids of
    the chunks in a row are those of the text.

    Chunks of up to 16 bytes are looked up as two numbers, which are their very
    bytes, in a table of two slots a chunk; what is not found there is looked
    up by its bytes, and asked of the library once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        path = tokenizer_path(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Whether every id fits into 16 bits.
        self.small = self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16
        # the blank before a word, and whether words are put in lower case, as far as the file says so plainly
        normal, before = json.dumps(spec.get("normalizer")), json.dumps(spec.get("pre_tokenizer"))
        self.blank: str | None = None
        if normal == "null" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space"):
            self.blank, self.lower = "\u0120", False
        elif "NFC" in normal and "Lowercase" in normal and "[\\\\p{L}]+" in before and '"Removed"' in before:
            self.blank, self.lower = "", True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.first, self.count = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint16)
        self.pool, self.held = np.zeros(1 << 16, np.uint32), 0

    def _word(self, chunk: str) -> list[int] | None:
        """Ids of a blank and letters, by the vocabulary's model alone, which is
        what is left of the library's work for them; None for other chunks."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if self.blank is None or not word.isalpha():
            return None
        blank = self.blank if chunk[:1] == " " else ""
        if self.lower:
            small = word if word.islower() else word.lower()
            if not word.isascii() and (len(small) != len(word) or "\u03a3" in word or not unicodedata.is_normalized("NFC", word)):
                return None
            word = small
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_NAMES)
        return [t.id for t in self.library.model.tokenize(blank + word)]

    def _ask(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _keep(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number in the pool of these lists of ids."""
        count = np.fromiter(map(len, found), np.int64, len(found))
        total = int(count.sum())
        if self.held + total > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.held + total), np.uint32)
            grown[: self.held] = self.pool[: self.held]
            self.pool = grown
        self.pool[self.held : self.held + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        first = self.held + np.cumsum(count) - count
        self.held += total
        return first, count

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number in the pool of these chunks' ids, which are found where they are not known."""
        new = list({c for c in chunks if c not in self.known})
        if new:
            spelled = [c.decode() for c in new]
            ids = [self._word(c) for c in spelled]
            rest = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(rest, self._ask([spelled[i] for i in rest]), strict=True):
                ids[i] = x
            first, count = self._keep(ids)
            self.known.update(zip(new, zip(first.tolist(), count.tolist(), strict=True), strict=True))
        got = np.array([self.known[c] for c in chunks], np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number in the pool of each chunk's ids."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))
        sizes = ends - starts
        low = eight[starts] & _FIRST[np.minimum(sizes, 8)]
        high = eight[starts + np.minimum(sizes, 8)] & _FIRST[np.clip(sizes - 8, 0, 8)]
        mixed = K.mix(low + high * np.uint64(0x9E3779B97F4A7C15))
        slots = (mixed >> np.uint64(43)).astype(np.int64), (mixed & np.uint64(SLOTS - 1)).astype(np.int64)
        short = sizes <= 16
        # a chunk that holds a NUL looks like one without it, or like a free slot
        nul = np.flatnonzero(data == 0)
        if len(nul) and len(starts):
            short[np.searchsorted(starts, nul, "right") - 1] = False
        at = slots[0]
        hit = short & (self.low[at] == low) & (self.high[at] == high)
        miss = np.flatnonzero(~hit & short)
        other = slots[1][miss]
        good = (self.low[other] == low[miss]) & (self.high[other] == high[miss])
        at[miss[good]] = other[good]
        first, count = self.first[at].astype(np.int64), self.count[at].astype(np.int64)
        hit[miss[good]] = True
        rest = np.flatnonzero(~hit)
        if len(rest):
            raw = data.tobytes()
            first[rest], count[rest] = self._learn([raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
            for slot in (mixed >> np.uint64(43), mixed & np.uint64(SLOTS - 1)):
                # a slot that is free takes a chunk; those that hold one keep it
                mine = rest[short[rest]]
                place, i = np.unique(slot[mine].astype(np.int64), return_index=True)
                free = self.low[place] == 0
                place, own = place[free], mine[i[free]]
                self.low[place], self.high[place], self.first[place], self.count[place] = low[own], high[own], first[own], count[own]
                for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True):
                    del self.known[raw[a:b]]
                there = slot[rest].astype(np.int64)
                rest = rest[(self.low[there] != low[rest]) | (self.high[there] != high[rest])]
        return first, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block of UTF-8, and the n + 1 bounds of the texts' ids."""
        if self.held > POOL or len(self.known) > BESIDES:
            self._forget()
        n = len(offsets) - 1
        there = offsets[:-1] < offsets[1:]
        white = _BLANK[data]
        cut = white.copy()
        cut[1:] &= ~white[:-1]
        cut[1:] |= _POINT[data[1:]] & _PLAIN[data[:-1]]
        cut[offsets[:-1][there]] = True
        owner = lambda at: K.owners(at, offsets)
        odd = np.zeros(n, bool)
        odd[owner(np.flatnonzero(_ODD[data]))] = True
        wide = np.flatnonzero(data >= 0xC2)
        if len(wide):
            text = np.unique(owner(wide))
            raw = data.tobytes()
            odd[[i for i in text.tolist() if _ODD_WIDE.search(raw[offsets[i] : offsets[i + 1]].decode())]] = True
        starts = np.flatnonzero(cut)
        whose = owner(starts)
        if odd.any():
            keep = ~odd[whose] | (starts == offsets[whose])
            starts, whose = starts[keep], whose[keep]
        ends = np.append(starts[1:], offsets[-1])
        if odd.any():
            first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            plain = ~odd[whose]
            first[plain], count[plain] = self._places(data, starts[plain], ends[plain])
            raw = data.tobytes()
            whole = [raw[a:b].decode() for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True)]
            first[~plain], count[~plain] = self._keep(self._ask(whole))
        else:
            first, count = self._places(data, starts, ends)
        last = np.cumsum(count)
        ids = self.pool[np.repeat(first - last + count, count) + np.arange(int(last[-1]) if len(last) else 0)]
        bounds = np.concatenate([[0], last])[np.searchsorted(whose, np.arange(n + 1))]
        return ids, bounds

    def __call__(self, batch: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit bytes."""
        out = []
        for ids in self.each(pa.array(batch, pa.large_string())):
            out.append(ids.astype("<u4").tobytes())
        return out

    def each(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column without nulls."""
        data, offsets = text_bytes(column)
        for a, b in blocks(offsets):
            ids, bounds = self.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                yield ids[bounds[i] : bounds[i + 1]]


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


_BYTE_NAMES = _byte_names()
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(column: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text of a column, with the end id."""
    end = np.array([end_id], "<u4")
    for ids in encoder(path).each(column):
        yield np.concatenate([ids, end])


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each text's ids and its end id,
    cut into pieces of ``capacity`` ids, the last of which may be shorter."""
    small_batches(docs.sparkSession)
    source = texts(docs, key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(_encoded(batch.column("text"), path, end_id)):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                [key, "piece", "start", "length", "ids_crc32"],
            )
        release()

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# ---- the file format --------------------------------------------------------


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


#: Sequences of a record batch; the last batch of a file may have fewer.
BATCH_ROWS = 256
#: Ids of a file, about; a task that has more writes several files.
FILE_IDS = 1 << 27


class _Writer:
    """One file of equal-length sequences, gapless but for the padding at its end."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, length: int, kind: pa.DataType, per_batch: int = BATCH_ROWS) -> None:
        self.length, self.kind, self.rows = length, kind, per_batch
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, _schema(length, kind))
        self.held: list[np.ndarray] = []
        self.count = 0

    def _put(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.file_schema()))

    def file_schema(self) -> pa.Schema:
        return _schema(self.length, self.kind)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        size = self.length * self.rows
        while self.count >= size:
            together = np.concatenate(self.held)
            self._put(together[:size], np.ones(size, bool))
            self.held = [together[size:]]
            self.count -= size

    def close(self) -> None:
        if self.count:
            ids = np.concatenate(self.held)
            padded = -(-len(ids) // self.length) * self.length
            out = np.zeros(padded, ids.dtype)
            out[: len(ids)] = ids
            self._put(out, np.arange(padded) < len(ids))
        self.file.close()
        self.sink.close()


def _map(fs: pa.fs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
    """A file's reader: mapped where the file is local, by ranges elsewhere."""
    local = isinstance(fs, pa.fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))


def read_ids(file: pa.ipc.RecordBatchFileReader, start: int, count: int, rows: int = BATCH_ROWS) -> list[np.ndarray]:
    """``count`` ids from place ``start`` of a file, as views of its batches: which
    batch holds a place follows from the place, since all but the last are of
    ``rows`` sequences."""
    out, size = [], rows * file.schema.field("ids").type.list_size
    while count:
        number, at = divmod(start, size)
        batch = file.get_batch(number)
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[at : at + count]
        if number == file.num_record_batches - 1:  # only there is padding
            mask = batch.column("mask").flatten().slice(at, len(ids))
            if mask.true_count < count:
                raise ValueError("the file ends before the text does")
        out.append(ids)
        start, count = start + len(ids), count - len(ids)
    return out


def write_sequences(
    docs: DataFrame,
    path: str,
    end_id: int,
    folder: str | None = None,
    length: int = 2048,
    small_ids: bool | None = None,
    key: str = "doc_id",
    text: str = "text",
    rows_per_file: int = 4000,
) -> tuple[str, DataFrame]:
    """Encode and write; gives the folder and the index (file, key, at, n_tokens).

    The texts are dealt by ranges of the key, sorted within each, and every
    range is written by the task that holds it, in one go, under a name of its
    own, so that a task that is run again leaves whole files only; the index
    names the files that count.  ``at`` is a text's place in its file.  Ids
    have 16 bits where every id of the vocabulary fits, else 32, unless
    ``small_ids`` says so.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "sequences")
    source = texts(docs, key, text=text)
    count = source.count()
    if not count:
        return folder, spark.createDataFrame([], f"file string, part long, `{key}` {source.schema[key].dataType.simpleString()}, at long, n_tokens long")
    parts = max(1, min(100_000, -(-count // rows_per_file)))
    if small_ids is None:
        small_ids = encoder(path).small and end_id < 1 << 16
    # rows of one id are dealt by their texts' hashes, so that a frequent id is no task of its own
    order = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64("text")]
    ranged = source.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = folder_files(folder)
        fs.create_dir(base, recursive=True)
        kind, dtype = (pa.uint16(), np.uint16) if small_ids else (pa.uint32(), np.uint32)
        writer, name, at, number = None, "", 0, 0
        for batch in batches:
            names, places, sizes = [], [], []
            for got in _encoded(batch.column("text"), path, end_id):
                if writer is None:
                    name = f"{part:08d}-{number:06d}-{uuid.uuid4().hex}.arrow"
                    writer, at, number = _Writer(fs, f"{base}/{name}", length, kind), 0, number + 1
                if small_ids and len(got) and int(got.max()) > 0xFFFF:
                    raise ValueError("an id does not fit into 16 bits")
                writer.add(got.astype(dtype))
                names.append(name)
                places.append(at)
                sizes.append(len(got))
                at += len(got)
                if at > FILE_IDS:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([part] * batch.num_rows, pa.int64()), batch.column(0), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                ["file", "part", key, "at", "n_tokens"],
            )
        if writer is not None:
            writer.close()
        release()

    index = ranged.mapInArrow(run, f"file string, part long, `{key}` {source.schema[key].dataType.simpleString()}, at long, n_tokens long")
    return folder, written(index, "sequence-index")


def read_sequences(spark: SparkSession, folder: str, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every text, read back from the files.

    The files' first places are sums over one row a file.  Each text is read by
    its place alone, from a file that is mapped where it is local.
    """
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("total"))
    # one row a file: a window over all of them is small by construction
    firsts = files.select("file", (F.sum("total").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))).alias("before")).na.fill({"before": 0})
    kind = index.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_files(folder)
        now, file = None, None
        for batch in batches:
            crcs = []
            for name, at, size in zip(*[batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")], strict=True):
                if name != now:
                    now, file = name, _map(fs, f"{base}/{name}")
                crc = 0
                for part in read_ids(file, at, size):
                    crc = zlib.crc32(part.astype("<u4", copy=False), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.compute.add(batch.column("before"), batch.column("at")), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                [key, "start", "n_tokens", "ids_crc32"],
            )

    ordered = index.join(firsts, "file").repartition(F.col("file")).sortWithinPartitions("file", "at")
    return ordered.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")
