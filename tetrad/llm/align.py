"""Alignment of two tokenizers' tokens of the same texts.

Both tokenizers' tokens spell the same bytes, so their ends are two rising
sequences of byte offsets.  Merging the two gives everything: offsets in both
end a group, and each stretch between two offsets of either lies in one token of
each side, which are linked.

Documents are worked on in blocks.  A block keeps its different links once, with
how many of its documents hold each, and a document keeps the numbers of its
links in that list.  So what is shuffled to be counted, and what comes back, are
the different links of blocks and not those of documents.

Defined results: texts that are null or empty, or whose tokens on one side do
not spell the text, have no tokens: zeros and an empty digest; texts of any
length are encoded whole; repeated rows and rows with a null key are documents
of their own; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm import kernels as K
from tetrad.llm import tokens as T
from tetrad.llm.shared import blocks, release, small_batches, text_bytes, texts

#: A block ends when its documents have so many links (counted once a document), or when it has so many documents.
LINKS, DOCUMENTS = 1 << 19, 1 << 15
#: Bytes of text that are merged at once (a longer text is merged alone).
MERGED = 1 << 18

_NEWLINE = 0x0A


class PieceEncoder(T.Encoder):
    """Ids of texts by a sentencepiece model without normalisation, after the
    blank that it puts before a text.

    A text is cut where no piece of the vocabulary has two such characters in a
    row: where a run of blanks begins, around line ends, and before punctuation
    that follows an ASCII letter or digit, each only as far as the vocabulary
    allows it.  Merges never reach across such a place, so the ids of the chunks
    in a row are those of the text.  Chunks are remembered as in ``Encoder``.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=T.tokenizer_path(path))
        size = self.library.get_piece_size()
        plain = [self.library.id_to_piece(i) for i in range(size) if not self.library.is_byte(i)]
        joined = {a + b for piece in plain for a, b in zip(piece, piece[1:], strict=False)}
        points = [chr(c) for c in np.flatnonzero(T._POINT)]
        self.cut_blank = not any(b == "▁" and a != "▁" for a, b in joined)
        self.cut_line = not any("\n" in piece for piece in plain)
        self.cut_point = not any(T._PLAIN[ord(a)] for a, b in joined if a.isascii() and b in points)
        self.prefix = self.library.encode("\n")
        if not self.cut_line or self.library.decode(self.library.encode("  a ①  ")) != "  a ①  ":
            raise ValueError("the model normalises texts, or has pieces with line ends")
        #: Bytes of each id, one after the other, and where they begin.
        self.spelled = [bytes([int(self.library.id_to_piece(i)[3:5], 16)]) if self.library.is_byte(i) else self.library.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.small = size <= 1 << 16
        self.blank = None
        self._forget()

    def _ask(self, chunks: list[str]) -> list[list[int]]:
        # a line end before a chunk takes the blank that the library puts before a text
        n = len(self.prefix)
        return [ids[n:] for ids in self.library.encode([f"\n{c}" for c in chunks], num_threads=1)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, whose blanks at the beginning are there, and the bounds of the texts' ids."""
        if self.held > T.POOL or len(self.known) > T.BESIDES:
            self._forget()
        cut = np.zeros(len(data), bool)
        blank, line = data == 0x20, data == _NEWLINE
        cut[1:] = line[1:] | line[:-1]
        if self.cut_blank:
            # the library takes U+2581 for a blank too, so a run goes on after it
            blank[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            cut[1:] |= (data[1:] == 0x20) & ~blank[:-1]
        if self.cut_point:
            cut[1:] |= T._POINT[data[1:]] & T._PLAIN[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        whose = K.owners(starts, offsets)
        first, count = self._places(data, starts, np.append(starts[1:], offsets[-1]))
        last = np.cumsum(count)
        ids = self.pool[np.repeat(first - last + count, count) + np.arange(int(last[-1]) if len(last) else 0)]
        return ids, np.concatenate([[0], last])[np.searchsorted(whose, np.arange(len(offsets)))]


def _byte_level(encoder: T.Encoder) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    back = {c: b for b, c in T._BYTE_NAMES.items()}
    words = encoder.library.get_vocab(with_added_tokens=True)
    out = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        out[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    return out


class Side:
    """One tokenizer: ids of texts, and the bytes of ids."""

    def __init__(self, path: str) -> None:
        self.encoder = PieceEncoder(path) if path.endswith(".model") else T.encoder(path)
        spelled = self.encoder.spelled if isinstance(self.encoder, PieceEncoder) else _byte_level(self.encoder)
        self.size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        #: Decimal digits of each id, in rows with room for a separator.
        digits = np.array([str(i) for i in range(len(spelled))], "S")
        width = digits.dtype.itemsize
        self.digits = np.pad(digits.view(np.uint8).reshape(-1, width), ((0, 0), (0, 1)))
        self.n_digits = np.char.str_len(digits).astype(np.int64)

    def spells(self, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the bytes of their ids spell."""
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        good = ends[bounds[1:]] - ends[bounds[:-1]] == np.diff(offsets)
        ids, data = ids[np.repeat(good, np.diff(bounds))], data[np.repeat(good, np.diff(offsets))]
        sizes = self.size[ids]
        same = self.bytes[np.repeat(self.first[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(data))] == data
        if not same.all():
            kept = np.flatnonzero(good)
            inner = np.concatenate([[0], np.cumsum(np.diff(offsets)[kept])])
            good[kept[K.owners(np.flatnonzero(~same), inner)]] = False
        return good


def _of(keep: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts to keep, and the bounds, where the others have none."""
    count = np.diff(bounds)
    return ids[np.repeat(keep, count)], np.concatenate([[0], np.cumsum(count * keep)])


class Merged:
    """A block of texts under both tokenizers, its ends merged."""

    def __init__(self, one: Side, other: Side, data: np.ndarray, offsets: np.ndarray) -> None:
        a, b = one.encoder.encode(data, offsets), other.encoder.encode(data, offsets)
        good = one.spells(*a, data, offsets) & other.spells(*b, data, offsets)
        (self.a, self.a_bounds), (self.b, self.b_bounds) = _of(good, *a), _of(good, *b)
        texts = np.concatenate([[0], np.cumsum(np.diff(offsets) * good)])
        end_a, end_b = np.cumsum(one.size[self.a]), np.cumsum(other.size[self.b])
        in_a, in_b = np.zeros(texts[-1] + 1, bool), np.zeros(texts[-1] + 1, bool)
        in_a[end_a] = in_b[end_b] = True
        # tokens and groups that end before each end of either side
        ends = np.flatnonzero(in_a | in_b)
        before = lambda flags: np.cumsum(flags[ends]) - flags[ends]
        self.link_a, self.link_b, both = before(in_a), before(in_b), in_a & in_b
        group = before(both)
        self.group_a, self.group_b = group[in_a[ends]], group[in_b[ends]]
        text = K.owners(ends - 1, texts) if len(ends) else ends
        n = len(offsets) - 1
        self.text = text
        self.n_links = np.bincount(text, minlength=n)
        self.n_groups = np.bincount(text[both[ends]], minlength=n)
        self.sides = one, other

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as text; empty without tokens."""
        one, other = self.sides
        place_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        place_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        total, width = len(self.a) + len(self.b), max(one.digits.shape[1], other.digits.shape[1])
        rows, size = np.zeros((total, width), np.uint8), np.zeros(total, np.int64)
        for side, ids, place, group, last in ((one, self.a, place_a, self.group_a, b"|"), (other, self.b, place_b, self.group_b, b";")):
            digits = np.pad(side.digits[ids], ((0, 0), (0, width - side.digits.shape[1])))
            size[place] = side.n_digits[ids]
            closes = np.append(group[1:] != group[:-1], True)[: len(ids)]
            digits[np.arange(len(ids)), side.n_digits[ids]] = np.where(closes, last[0], ord(","))
            rows[place] = digits
        flat = rows[np.arange(width) <= size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])[self.a_bounds + self.b_bounds]
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() if i < j else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): the different links of each text; a pair is one id above 32 bits and the other below."""
        pair = (self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b].astype(np.int64)
        known, number = np.unique(pair, return_inverse=True)
        both, times = np.unique(self.text * max(1, len(known)) + number, return_counts=True)
        text, number = np.divmod(both, max(1, len(known)))
        return text, known[number], times


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    """The process's tables of a tokenizer file."""
    if path not in _sides:
        _sides[path] = Side(path)
    return _sides[path]


DOCUMENT = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place array<int>, times array<int>, pair array<long>, held array<int>"


class _Block:
    """Documents of a block, as they come."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, key: object, numbers: tuple[int, ...], digest: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append((key, *numbers, digest))
        self.pairs.append(pairs)
        self.times.append(times)
        self.links += len(pairs)

    def batch(self, number: int, key: pa.DataType, names: list[str]) -> pa.RecordBatch:
        """Its rows; the first one has the block's links."""
        pairs = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        known, place = np.unique(pairs, return_inverse=True)
        held = np.bincount(place, minlength=len(known))
        n = len(self.rows)
        at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in self.pairs])]), pa.int32())
        first = pa.array(np.concatenate([[0], np.full(n, len(known))]), pa.int32())
        columns = list(zip(*self.rows, strict=True))
        lists = [
            pa.ListArray.from_arrays(at, pa.array(place, pa.int32())),
            pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *self.times]), pa.int32())),
            pa.ListArray.from_arrays(first, pa.array(known, pa.int64())),
            pa.ListArray.from_arrays(first, pa.array(held, pa.int32())),
        ]
        numbers = [pa.array(c, pa.int64()) for c in columns[1:5]]
        head = [pa.array(columns[0], key), pa.array([number] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *numbers, pa.array(columns[5], pa.string()), *lists], names)


def blocks_of_links(docs: DataFrame, one: str, other: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents by blocks: their numbers, their digest, and their links as places
    in the list of the block's links, which the block's first row has."""
    small_batches(docs.sparkSession)
    plain = texts(docs, key, text=text)
    source = plain.select(F.col(f"`{key}`").alias("doc_id"), F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise("").alias("text"))
    names = ["doc_id", *(part.split()[0] for part in DOCUMENT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = side(one), side(other)
        made, block, kind = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            keys, kind = batch.column("doc_id"), batch.schema.field("doc_id").type
            data, offsets = text_bytes(batch.column("text"))
            for i, j in blocks(offsets, MERGED):
                m = Merged(*sides, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of, pair, times = m.links()
                cuts = np.searchsorted(of, np.arange(j - i + 1)).tolist()
                numbers = np.stack([np.diff(m.a_bounds), np.diff(m.b_bounds), m.n_groups, m.n_links], axis=1).tolist()
                for k, (doc, counts, digest) in enumerate(zip(keys.slice(i, j - i).to_pylist(), numbers, m.digests(), strict=True)):
                    block.add(doc, tuple(counts), digest, pair[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]])
                    if block.links >= LINKS or len(block.rows) >= DOCUMENTS:
                        yield block.batch(made, kind, names)
                        made, block = made + 1, _Block()
        if block.rows:
            yield block.batch(made, kind, names)
        release()

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {DOCUMENT}")


def align(docs: DataFrame, one: str, other: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A link's count is the number of documents that hold it; ``count_sum`` adds the
    counts of a document's links up, and ``n_best`` is how many of them have the
    highest count of all links of their first id.
    """
    made = blocks_of_links(docs, one, other, key, text).persist(StorageLevel.DISK_ONLY)  # lost blocks are made again
    made.count()  # now, and once: the stages below run side by side and would each begin it
    pairs = made.where(F.size("pair") > 0).select("block", F.posexplode(F.arrays_zip("pair", "held")).alias("place", "x")).select("block", "place", "x.pair", "x.held")
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    judged = counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = pairs.join(judged, "pair").select(F.col("block").alias("of"), F.col("place").alias("number"), "count", "best")
    kind = made.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def look_up(documents: pa.Table, links: pa.Table) -> pa.Table:
        where = links.column("number").to_numpy()
        count, best = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        count[where], best[where] = links.column("count").to_numpy(), links.column("best").to_numpy()
        n_best, count_sum = [], []
        for place, times in zip(documents.column("place"), documents.column("times"), strict=True):
            place, times = place.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            n_best.append(int(times @ best[place]))
            count_sum.append(int(times @ count[place]))
        added = documents.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return added.select(names)

    documents = made.drop("pair", "held")
    return documents.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
