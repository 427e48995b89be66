"""Document fingerprints from closed syncmers (native Spark).

A text's symbols are its words (of ``LONGEST`` characters at most; longer runs
without a blank are cut) and, in scripts that put no blanks between words, its
characters.  A k-mer is a run of ``K`` symbols, with marks before the first and
behind the last symbol, so that every text has some; its inner substrings are
the runs of ``S`` symbols.  It is chosen if the least hash of its inner
substrings stands at its first or last place (a closed syncmer): whether it is
chosen depends on its own symbols only, so an edit elsewhere changes nothing.

The chosen k-mers are the anchors.  Each one is bound to the next by the number
of symbols between them, which is what positional matching compares: two texts
have a link in common where the same two anchors stand in the same distance,
wherever that is in either.  A fingerprint is all links in the order of their
places, 8 hexadecimal digits each, so its length follows the text's (two links
for seven symbols); the likeness of two is the share of common links among all
of both.

Defined results: null texts are as empty ones, whose symbol is one empty word;
equal texts have equal fingerprints; of rows with the same id, the order is by
text; null ids come last; ids are whole numbers; a single document is its own
next; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm.shared import texts

K, S = 8, 2
LONGEST = 24
#: Words of scripts with blanks, or single characters of others.
SYMBOL = rf"[^\s\x{{2E80}}-\x{{D7FF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{3FFFF}}]{{1,{LONGEST}}}|\S"
#: Cells of a share of the ids that are counted on the driver to cut it into buckets.
CELLS = 1 << 9
#: Shares of the ids of about as many rows.
SHARES = 64
#: Most buckets, and the rows that a bucket aims at below it.
BUCKETS, BUCKET_ROWS = 1 << 13, 400


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the links of the text's closed syncmers, in their order (array of int)."""
    # one step a column, so that each array is made once
    symbols = F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0))
    marks = lambda first: F.array(*[F.lit(first + i) for i in range(K - 1)])
    df = df.withColumn("_h", F.concat(marks(0), F.transform(F.when(F.size(symbols) > 0, symbols).otherwise(F.array(F.lit(""))), lambda w: F.xxhash64(w)), marks(K)))
    pair = lambda x, y, n, f: F.zip_with(x, F.slice(x, n + 1, F.size(x) - n) if y is None else y, f)
    df = df.withColumn("_s", pair("_h", None, 1, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_m", pair("_s", None, 1, lambda a, b: F.least(a, b)))
    # the inner substrings of the k-mer at i are _s[i] to _s[i + 6]; the five between the first and the last have their least in _m
    at = lambda c, i: F.get(c, i)
    chosen = F.filter(
        F.sequence(F.lit(0), F.size("_h") - K),
        lambda i: F.least(at("_s", i), at("_s", i + 6)) <= F.least(at("_m", i + 1), at("_m", i + 3), at("_s", i + 5)),
    )
    df = df.withColumn("_c", chosen)
    # an anchor is named by its outer inner substrings and a middle one
    df = df.withColumn("_v", F.transform("_c", lambda i: F.xxhash64(at("_s", i), at("_s", i + 2), at("_s", i + 4), at("_s", i + 6))))
    link = lambda v, n: F.shiftright(F.xxhash64(v, at("_v", n + 1), at("_c", n + 1) - at("_c", n)), 32).cast("int")
    return df.withColumn(out, F.transform("_v", link)).drop("_h", "_s", "_m", "_c", "_v")


def printed(links: str) -> Column:
    """The fingerprint's text: 8 hexadecimal digits for each link."""
    return F.array_join(F.transform(links, lambda v: F.substring(F.lpad(F.hex(v.cast("bigint")), 16, "0"), 9, 8)), "")


def likeness(a: str, b: str) -> Column:
    """Share of common links among all different links of both, 0 to 1."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(1.0))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every text; nothing is shuffled."""
    return with_anchors(texts(docs, key, text=text), "text", "_a").select(f"`{key}`", printed("_a").alias("fingerprint"))


def _buckets(ids: DataFrame, key: str) -> tuple[Column, list[int | None], list[int]] | None:
    """Bucket of an id as a column, each bucket's largest id, and for each bucket
    the one before it in descending order of ids (the last for the first).

    The ids are cut at quantiles into shares of about as many rows, and each share
    into cells of equal width, so ids far from the others spoil one share only.
    """
    cuts, low, high, n = ids.agg(F.percentile_approx(key, [k / SHARES for k in range(1, SHARES)], 10_000), F.min(key), F.max(key), F.count(F.lit(1))).first()
    if not n:
        return None
    bounds = sorted({low if low is not None else 0, *(cuts or ()), (high if high is not None else 0) + 1})
    own = F.coalesce(F.col(f"`{key}`"), F.lit(bounds[0]))
    share = F.size(F.filter(F.lit(bounds[1:-1] or [bounds[-1]]), lambda c: c <= own))
    widths = [max(1, -(-(b - a) // CELLS)) for a, b in zip(bounds, bounds[1:], strict=False)]
    cell = (share * CELLS + F.floor((own - F.get(F.lit(bounds), share)) / F.get(F.lit(widths), share))).cast("int")
    counted = ids.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top")).collect()  # at most SHARES x CELLS rows
    least = max(BUCKET_ROWS, -(-n // BUCKETS))
    bucket_of, tops, held = [0] * (max(r["cell"] for r in counted) + 1), [], 0
    for r in sorted(counted, key=lambda r: r["cell"]):
        if not tops or held >= least:
            tops.append(r["top"])
            held = 0
        tops[-1] = r["top"] if r["top"] is not None else tops[-1]
        held += r["n"]
        bucket_of[r["cell"]] = len(tops) - 1
    number = F.get(F.lit(bucket_of), cell)
    return number, tops, [(b + 1) % len(tops) for b in range(len(tops))]


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Add ``next_<column>``: the columns of the next row in descending order of
    the key (after the last: the first).

    Rows are dealt once, by buckets of the id range; the largest id of each
    bucket is also sent to the bucket above it, whose last row it follows.
    """
    cut = _buckets(docs.select(f"`{key}`"), key)
    if cut is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    number, tops, above = cut
    dealt = docs.withColumn("_own", number)
    is_top = F.col(f"`{key}`").eqNullSafe(F.get(F.lit(tops) if tops != [None] else F.array(F.lit(None).cast("long")), F.col("_own")))
    own = F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(F.lit(above), F.col("_own")).alias("bucket"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("_at", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.bucket").orderBy("_at.guest", F.col(f"`{key}`").desc_nulls_last(), "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("_at.guest")).drop("_own", "_at")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last half is the
    start of the next document, and the likeness to that and to the next."""
    source = with_anchors(texts(docs, key, text=text), "text", "_a")
    pairs = with_next(source, ["text", "_a"], key)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.char_length("text") - half), F.substr("next_text", F.lit(1), half))
    pairs = pairs.select(f"`{key}`", "_a", "next__a", F.char_length("text").cast("long").alias("n_chars"), edited.alias("_edited"))
    both = with_anchors(pairs, "_edited", "_e")
    return both.select(
        f"`{key}`",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        printed("_a").alias("fingerprint"),
        printed("_e").alias("edited_fingerprint"),
        likeness("_a", "_e").alias("near_edited"),
        likeness("_a", "next__a").alias("near_next"),
    )
