from tetrad.streaming.words import new_words, windowed_words


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("b\na\nb\n")
    lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    q = new_words(lines).writeStream.format("memory").queryName("new_words").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("new_words").collect()) == ["a", "b"]
    timed = lines.selectExpr("value", "timestamp'2024-01-01 00:03:00' as ts")
    q = windowed_words(timed, "ts").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["word"], r["n"]) for r in spark.table("windowed").collect()) == [("a", 1), ("b", 2)]
    q = new_words(timed, time="ts").writeStream.format("memory").queryName("bounded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["word"] for r in spark.table("bounded").collect()) == ["a", "b"]
