"""Best-fit packing by minimum bin slack, planned on the histogram of lengths.

Only the counts of pieces by length reach the driver (at most ``capacity``
rows, and one more for every half million pieces).  There each bin is filled by a bitset subset-sum
over the lengths still available, starting from the longest; the fullest
feasible combination is removed as often as its lengths last, which is what
packing bin by bin would do.  Each removal uses up a length, so there are at
most about ``capacity`` different bins in the plan.  Pieces then find their
place by their rank within their length.

Defined results: null and empty texts are one piece (the end id alone);
repeated rows are packed as often as they come; texts longer than the capacity
are cut into pieces; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm.shared import written
from tetrad.llm.tokens import pieces


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The combination of available lengths, the longest among them, that fills
    a bin best.  ``lengths`` are those with a count, ascending."""
    longest = lengths[-1]
    room = capacity - longest
    used = {longest: 1}
    fit = [x for x in lengths[: bisect_left(lengths, room + 1)]]
    if not fit or not room:
        return used
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []  # bit b: a subset of what was offered so far sums to b
    for length in reversed(fit):
        most = min(counts[length] - (length == longest), room // length)
        copies = 1
        while most > 0:  # so many copies at once: any number from 0 to most can be made
            take = min(copies, most)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            most -= take
            copies *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            left -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (copies by length, how many such bins)."""
    counts = {k: n for k, n in counts.items() if n}
    lengths, bins = sorted(counts), []
    while lengths:
        used = fullest(counts, lengths, capacity)
        times = min(counts[k] // n for k, n in used.items())
        bins.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
                lengths.pop(bisect_left(lengths, k))
    return bins


def place(made: DataFrame, capacity: int, key: str = "doc_id", per_share: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces that can be read again.

    Ranks within a length are counted in shares of about ``per_share`` pieces,
    so a length that holds a large part of all rows is dealt to many tasks.
    """
    spark = made.sparkSession
    order = [f"`{key}`", "piece", "start", "ids_crc32"]
    total = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shares = {length: -(-n // per_share) for length, n in total.items() if n > per_share}
    salts = F.lit(1)
    if shares:
        salts = F.coalesce(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("length")], salts)
    salted = made.withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    counted = salted.groupBy("length", "_salt").count().collect()  # one row a length, and one more for every ``per_share`` pieces
    slots: dict[int, list[tuple[int, ...]]] = {}  # by length: ranks from, to, copies in a bin, first bin, offset of the first copy
    given: dict[int, int] = {}
    first_bin = 0
    for used, times in plan(total, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            n, at = used[length], given.get(length, 0)
            slots.setdefault(length, []).append((at, at + n * times, n, first_bin, offset))
            given[length] = at + n * times
            offset += n * length
        first_bin += times
    # each share with the ranks before it and the slots that its own ranks meet
    rows, before = [], dict.fromkeys(total, 0)
    for r in sorted(counted, key=lambda r: (r["length"], r["_salt"])):
        length, low = r["length"], before[r["length"]]
        before[length] = high = low + r["count"]
        own = slots[length]
        i, j = bisect_right(own, low, key=lambda s: s[1]), bisect_left(own, high, key=lambda s: s[0])
        rows.append((length, r["_salt"], low, own[i:j]))
    table = spark.createDataFrame(rows, "length long, _salt int, _before long, _slots array<struct<low: long, high: long, copies: long, bin: long, offset: long>>")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", rank).join(table, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    slot = F.filter("_slots", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["high"]))[0]
    ranked = ranked.withColumn("_slot", slot)
    within = F.col("_rank") - F.col("_slot.low")
    bin_id = F.col("_slot.bin") + (within / F.col("_slot.copies")).cast("long")
    return ranked.select(
        *[F.col(f"`{c}`") for c in made.columns],
        bin_id.alias("sequence_id"),
        (F.col("_slot.offset") + F.pmod(within, F.col("_slot.copies")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return place(written(pieces(docs, path, end_id, capacity, key, text), "pieces"), capacity, key)
