"""Parsing and writing of the text formats."""

from tetrad.operators import rules, transfer, windows
from tetrad.sources import text


def lines(spark, *values):
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "value string, line_no int")


def test_words_and_formats(spark):
    assert sorted(r[0] for r in text.word_list(lines(spark, " a ", "b", "", "a")).collect()) == ["a", "b"]
    assert text.sniff_sigmorphon(lines(spark, "a")) == "plain"
    assert text.sniff_sigmorphon(lines(spark, "a\tpos=N,num=SG\tb")) == "sig2016"
    assert text.sniff_sigmorphon(lines(spark, "a\tb\tN;SG")) == "sig2017"
    rows = text.sigmorphon(lines(spark, "go\twent\tV;PST", "bad line")).collect()
    assert [(r["lemma"], r["form"], r["feats"]) for r in rows] == [("go", "went", ["V", "PST"])]
    assert text.blind(lines(spark, "go\tV;PST")).collect()[0]["msd"] == "V;PST"


def test_vectors_clusters_equivalents(spark):
    assert text.vectors(lines(spark, "# a == b", "ab\t(1, 0, 12)", "c\t(7)")).collect() == [("ab", [1, 0, 12]), ("c", [7])]
    rows = text.clusters(lines(spark, "# note", "a : b :: c : d")).collect()
    assert [(r["pos"], r["a"], r["b"]) for r in rows] == [(0, "a", "b"), (1, "c", "d")]
    assert text.equivalents(lines(spark, "# b == a")).collect()[0]["rep"] == "a"


def test_grids_round_trip(spark):
    cells = text.grids(lines(spark, "a : b : None :: c : None : d"))
    assert {(r["row"], r["col"], r["word"]) for r in cells.collect()} == {(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 2, "d")}
    assert text.grid_lines(cells).collect()[0]["value"] == "a : b : None :: c : None : d"
    assert len(text.pretty_grids(cells).collect()) == 2


def test_language_table(spark):
    got = text.markdown_languages(lines(spark, "| f | n | c |", "|---|---|---|", "| Indo-European | German | deu |", "| | Dutch | nld |", "| Uralic | Finnish | fin |")).collect()
    assert [tuple(r) for r in got] == [("deu", "germanic", "German"), ("nld", "germanic", "Dutch"), ("fin", "uralic", "Finnish")]


def test_tuple_cells_and_json(spark):
    df = spark.createDataFrame([("(0.9, 0.8, 0.7)",)], "c string")
    assert df.select(text.tuple_cell("c")).first()[0] == 0.8
    assert text.to_json_map(spark.createDataFrame([("a", 1)], "k string, v int"), "k", "v").first()[0] == '{"a":1}'


def test_runs(spark):
    df = spark.createDataFrame(list(enumerate("aabbba")), "i int, v string")
    assert sorted((r["first"], r["last"], r["v"], r["n"]) for r in windows.run_blocks(df, "v", "i").collect()) == [(0, 1, "a", 2), (2, 4, "b", 3), (5, 5, "a", 1)]


def test_rules(spark):
    trees = spark.createDataFrame([("x", '{"a": {"b": "s|t"}, "c": "u"}')], "lang string, tree string")
    assert {(tuple(r["path"]), r["leaf"]) for r in rules.leaves(trees).collect()} == {(("a", "b"), "s|t"), (("c",), "u")}
    one, other = rules.leaves(trees), spark.createDataFrame([("y", ["a"], "t")], "lang string, path array<string>, leaf string")
    assert tuple(rules.similarity(one, other).first()) == (1, 2, 50)


def test_languages(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.1), ("c", "d", 0.9), ("a", "d", 0.1), ("b", "d", 0.1)], "l1 string, l2 string, weight double")
    assert dict(map(tuple, transfer.communities(edges).collect())) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    steps = transfer.dendrogram(edges).orderBy("step").collect()
    assert [r["size"] for r in steps] == [2, 2, 4]


def test_matrix_file(spark, tmp_path):
    rows = [(m, d, 0.5 + i / 10, 1.0, None if m == d else 1e-05) for i, m in enumerate(("de", "en-x", "f r")) for d in ("de", "en-x", "a.b") if (m, d) != ("de", "a.b")]
    long = spark.createDataFrame(rows, "model_lang string, data_lang string, acc_valid double, acc_invalid double, acc_raw double")
    text.write_matrix(long, str(tmp_path / "m.csv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m.csv")).collect()]
    assert lines[0] == "model_lang,a.b,de,en-x" and len(lines) == 4 and lines[1].startswith('de,,"(0.5, 1.0, nan)"')
    assert sorted(map(tuple, text.read_matrix(spark, str(tmp_path / "m.csv")).collect())) == sorted(rows)
    assert text.matrix(text.matrix_table(long.limit(0))).count() == 0
