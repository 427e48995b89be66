"""Registered queries that take their whole input, against plain versions."""

from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tetrad.operators import analogies
from tetrad.plans import queries


def test_class_pairs_of_large_classes(spark, tmp_path):
    """A class of more than 2000 rows keeps its band of 1,000,000 // n pairs a row."""
    rows = [(i, f"name {i}", "large" if i < 2100 else "small", "type") for i in range(2130)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.QUERIES["msd_class_pairs"](spark, str(tmp_path))
    found = {r["brand"]: tuple(r)[1:] for r in got.groupBy("brand").agg(F.count("i"), F.countDistinct("i", "j"), F.min(F.col("j") - F.col("i")), F.max(F.col("j") - F.col("i"))).collect()}
    for brand, n in (("large", 2100), ("small", 30)):
        k = min(n, 1_000_000 // n)
        pairs = sum(min(k, n - i) for i in range(n))
        assert found[brand] == (pairs, pairs, 0, k - 1)
    total = sum(x[0] for x in found.values())
    assert queries.QUERIES["enrich_quads"](spark, str(tmp_path)).count() == 8 * total
    assert queries.QUERIES["negative_quads"](spark, str(tmp_path)).count() == 3 * total
    assert queries.QUERIES["balanced_negatives"](spark, str(tmp_path)).where("i >= 2100").count() == 8 * found["small"][0]


def _parts(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_meet_in_cells(spark, tmp_path):
    """Rows of a class meet by cells of the band, not each with each, and bring their words; a key in two rows gives what SQL's joins give."""
    rows = [(i, f"name {i % 7}", f"brand {i % 3}" if i % 5 else None, f"type {i % 4}") for i in range(90)]
    for name, more in (("keys", []), ("twice", [(8, "name x", "brand 2", "type x"), (9, "name 1", "brand 1", "name 1")])):
        _parts(spark, tmp_path / name, rows + more)
        db = duckdb.connect()
        db.execute(f"create view part as select * from '{tmp_path / name}/part.parquet/*.parquet'")
        for query in ("msd_class_pairs", "negatives_of_one_form", "balanced_negatives", "enrich_quads"):
            got = queries.QUERIES[query](spark, str(tmp_path / name))
            want = db.execute(queries.SQL[query])
            # which of two rows of a key a negative is of, the order by md5 leaves open
            shown = [c[0] for c in want.description if (name, query) != ("twice", "balanced_negatives") or c[0] not in "abcd"]
            assert sorted(tuple(r[c] for c in shown) for r in got.collect()) == sorted(want.df()[shown].itertuples(index=False, name=None)), (name, query)
            if name == "keys":
                joins = [x for x in _plan(got).splitlines() if "Join" in x and ">= p#" in x]
                assert len(joins) == 1 and "(cell#" in joins[0], query


def test_all_pairs_of_a_class(spark):
    """Without a number of pairs none is left out, also where the band drops most, and no cell has more than 1000 rows."""
    small = [(i, f"brand {i % 3}" if i % 5 else None, f"type {i % 4}", f"name {i % 7}") for i in range(90)]
    rows = spark.createDataFrame([*small, *[(i, "large", "type", f"name {i}") for i in range(100, 2400)]], "id long, brand string, lemma string, form string")
    want = {(x[0], y[0], *x[2:], *y[2:]) for x in small for y in small if x[1] and x[1] == y[1] and x[0] <= y[0]}
    for distinct in (True, False):
        got = analogies.of_classes(rows, "brand", "id", "lemma", "form", pairs=None, distinct=distinct)
        found = [tuple(r) for r in got.where("i < 100").select("i", "j", "a", "b", "c", "d").collect()]
        assert len(found) == len(want) and set(found) == want
        of = tuple(got.where("i >= 100").agg(F.count("i"), F.sum(F.col("j") - F.col("i")), F.min(F.col("j") - F.col("i")), F.max(F.col("j") - F.col("i"))).first())
        assert of == (2300 * 2301 // 2, sum(k * (2300 - k) for k in range(2300)), 0, 2299)
        held = analogies.balanced_negatives(got, ["i", "j"], all_forms=False)
        assert held.where("i >= 100").groupBy("form").count().count() == 0 and held.where("i < 100").count() == 3 * sum(x[2] != x[4] and x[3] != x[5] for x in want)
    assert analogies.class_pairs(rows, "brand", "id").where("brand = 'large'").count() < 2300 * 434
    x, _ = analogies._band(spark.range(5000).selectExpr("'one' brand", "id"), "brand", "id", None)
    assert sorted(r[1] for r in x.groupBy("cell").count().collect()) == [1000] * 5


def test_negatives_are_picked_before_they_are_made(spark, tmp_path):
    """No window over the 24 negatives of a pair."""
    _parts(spark, tmp_path, [(i, f"name {i}", "brand", f"type {i}") for i in range(9)])
    got = queries.QUERIES["balanced_negatives"](spark, str(tmp_path))
    assert "md5" not in "".join(x for x in _plan(got).splitlines() if "Window" in x) and got.count() == 45 * 8
    assert _plan(queries.QUERIES["negatives_of_one_form"](spark, str(tmp_path))).count("cdab") == 0


def test_whole_vocabulary(spark, tmp_path):
    """More than 2000 tokens in four languages: the rare ones stay, in every language."""
    letters = "abcdefghijkl"
    made = {lang: ["".join(letters[(i // 12**k) % 12] for k in range(4)) + end for i in range(2500)] for lang, end in (("en", ""), ("de", "ü"), ("es", "x"), ("fr", ""))}
    rows = [(n, " ".join(w[k : k + 500]), lang) for lang, w in made.items() for n, k in enumerate(range(0, 2500, 500))]
    rows += [(9, None, "en"), (10, "Rare RARE", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    words = {w for x in made.values() for w in x} | {"rare"}
    of = defaultdict(list)
    for w in sorted(words):
        of["".join(sorted(w))].append(w)
    assert sorted(run("alphagrams")) == sorted((w, a) for a, x in of.items() for w in x)
    assert sorted(run("inverse_dictionary")) == sorted((a, " ".join(x)) for a, x in of.items())
    assert sorted(run("indistinguishables")) == sorted((x[0], " ".join(x)) for x in of.values())
    assert sorted(run("equivalents_of_word")) == sorted((w, " ".join(x)) for x in of.values() for w in x)
    assert {w for w, _ in run("train_test_split")} == words and len(run("random_sample_100")) == 100
    checked = run("ascii_checks")
    assert len(checked) == 4 * 2500 + 1 and {r[0] for r in checked if not r[2]} == {"de"}
    assert len(run("sample_each_language")) == 80
    assert run("transfer_matrix") == []  # no word is another one and a letter


def test_words_meet_by_their_letters(spark, tmp_path):
    """Classes of equal vectors and their files, as SQL has them; documents are read once, and no vectors are made to group by."""
    rows = [(1, "Ab ba b\U00010400c c\U00010428b aab", "en"), (2, None, "de"), (3, "", "fr"), (4, "ünü nüü x-y Yx aba baa aba", "de"), (5, "AB 12 x", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for query in ("equivalents_of_word", "indistinguishables", "vector_file_source", "vector_file", "equivalents_source"):
        got = queries.QUERIES[query](spark, str(tmp_path))
        want = db.execute(queries.SQL[query])
        found = [tuple(r[c[0]] for c in want.description) for r in got.collect()]
        assert sorted(found) == sorted(want.fetchall()) and found, query
        plan = _plan(got)
        assert plan.count("lower(text#") == (query in ("indistinguishables", "equivalents_of_word")), query
        assert all("_letters" in x for x in plan.splitlines() if "collect_set" in x), query
