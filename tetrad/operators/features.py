"""Feature vectors of words: dimensions, vectors, equivalence classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.functions.strings import alphagram, char_vector, chars, token_vector


def alphabet(words: DataFrame, column: str = "word") -> DataFrame:
    """(ch): the distinct characters."""
    return words.select(F.explode(chars(column)).alias("ch")).distinct()


def symbols(rows: DataFrame, column: str) -> list[str]:
    """A dimension's symbols in order.  Alphabets and tag sets only: they are the
    columns of the vectors and must fit one."""
    return [r[0] for r in rows.select(column).distinct().orderBy(column).collect()]


def vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """(ch, id): characters numbered from 0 in order; the alphabet is small."""
    from pyspark.sql import Window

    return alphabet(words, column).withColumn("id", F.row_number().over(Window.orderBy("ch")) - 1)


def char_vectors(words: DataFrame, letters: list[str] | None = None, column: str = "word") -> DataFrame:
    """(word, v) with counts of the letters, by default of all that occur."""
    letters = symbols(alphabet(words, column), "ch") if letters is None else letters
    return words.select(F.col(column).alias("word"), char_vector(column, letters).alias("v"))


def char_counts(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, ch, n): the sparse form."""
    return words.select(F.col(column).alias("word"), F.explode(chars(column)).alias("ch")).groupBy("word", "ch").agg(F.count(F.lit(1)).alias("n"))


def dimensions(rows: DataFrame, column: str) -> DataFrame:
    """(symbol, at): the distinct values in order, numbered from 0.  They are
    numbered share by share of a range of them, so no task orders them all."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(column).alias("symbol")).distinct().repartitionByRange(spread, "symbol").sortWithinPartitions("symbol")
    dealt = dealt.select("symbol", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).persist()
    shares = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect()  # one row a partition
    before, known = 0, []
    for r in sorted(shares, key=lambda r: r["part"]):
        known.append((r["part"], r["first"] - before))
        before += r["n"]
    shift = rows.sparkSession.createDataFrame(known, "part int, shift long")
    return dealt.join(F.broadcast(shift), "part").select("symbol", (F.col("id") - F.col("shift")).cast("int").alias("at"))


def _dense(counts: DataFrame, n: int) -> DataFrame:
    """(word, v) of n places from (word, at, n)."""
    of = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    return of.select("word", F.transform(places, lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("int")).alias("v"))


def token_counts(words: DataFrame, delimiter: str = " ", column: str = "word") -> DataFrame:
    """(word, token, n): the sparse form."""
    found = words.select(F.col(column).alias("word"), F.explode(F.split(column, "\\Q" + delimiter + "\\E")).alias("token")).where("token <> ''")
    return found.groupBy("word", "token").agg(F.count(F.lit(1)).alias("n"))


def token_vectors(words: DataFrame, delimiter: str = " ", tokens: list[str] | None = None, column: str = "word") -> DataFrame:
    """(word, v) of distinct words, with counts of whole tokens, by default of all
    that occur; the tokens stay a table.  A vector has a place for each of them:
    for large vocabularies ``token_counts`` is the form to work with."""
    if tokens is not None:
        return words.select(F.col(column).alias("word"), token_vector(column, tokens, delimiter).alias("v"))
    counted = token_counts(words.select(column).distinct(), delimiter, column)
    numbered = dimensions(counted, "token")
    n = numbered.count()
    return _dense(counted.join(numbered, counted["token"] == numbered["symbol"]).select("word", "at", "n"), n)


def tag_vectors(forms: DataFrame, mode: str = "tag", delimiter: str = ";") -> DataFrame:
    """(word, v) of (form, msd): in mode 'tag' 1 for each feature that is there,
    in mode 'char' the counts of the tag string's characters."""
    if mode == "char":
        return char_vectors(forms.select("msd").distinct(), column="msd").withColumnRenamed("word", "msd").join(forms, "msd").select(F.col("form").alias("word"), "v")
    feats = F.split("msd", delimiter)
    tags = symbols(forms.select(F.explode(feats).alias("t")), "t")
    return forms.select(F.col("form").alias("word"), F.array(*[F.array_contains(feats, t).cast("int") for t in tags]).alias("v"))


def lemma_vectors(forms: DataFrame) -> DataFrame:
    """(word, v) of (form, lemma): one place for each lemma, the lemmas stay a table."""
    numbered = dimensions(forms, "lemma")
    n = numbered.count()
    placed = forms.join(numbered, F.col("lemma") == F.col("symbol")).select(F.col("form").alias("word"), "at")
    return placed.select("word", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("at")).cast("int")).alias("v"))


def concatenated(one: DataFrame, other: DataFrame) -> DataFrame:
    """(word, v) of the words in both, one vector behind the other."""
    return one.withColumnRenamed("v", "_v").join(other, "word").select("word", F.concat("_v", "v").alias("v"))


def equivalence_classes(vectors: DataFrame) -> DataFrame:
    """(rep, members, v): words of the same vector; the smallest represents them."""
    classes = vectors.groupBy("v").agg(F.array_sort(F.collect_set("word")).alias("members"))
    return classes.select(F.get("members", F.lit(0)).alias("rep"), "members", "v")


def representatives(vectors: DataFrame) -> DataFrame:
    """(word, v): one word for each vector."""
    return vectors.groupBy("v").agg(F.min("word").alias("word")).select("word", "v")


def anagrams(words: DataFrame, column: str = "word") -> DataFrame:
    """(rep, members): the ``equivalence_classes`` of ``char_vectors`` over all
    letters, found without vectors: words meet by their letters in order.  The
    number of shares keeps small words, of which much is made, from one task."""
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.select(F.col(column).alias("word"), alphagram(column).alias("_letters")).repartition(spread, "_letters")
    classes = rows.groupBy("_letters").agg(F.array_sort(F.collect_set("word")).alias("members"))
    return classes.select(F.get("members", F.lit(0)).alias("rep"), "members")


def anagram_vectors(words: DataFrame, column: str = "word") -> DataFrame:
    """(rep, members, v): the same classes with the vectors of those that
    represent them; a vector is made once a class."""
    letters = symbols(alphabet(words, column), "ch")
    return anagrams(words, column).select("rep", "members", char_vector("rep", letters).alias("v"))


def equivalents(words: DataFrame | None, classes: DataFrame) -> DataFrame:
    """(word, members): all equivalents of each word, itself if it is in no class;
    without words, of those of the classes."""
    of = classes.select(F.explode("members").alias("word"), "members")
    if words is None:
        return of
    return words.join(of, "word", "left").select("word", F.coalesce("members", F.array("word")).alias("members"))


def inverse(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): all keys of each value."""
    return rows.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias("keys"))
