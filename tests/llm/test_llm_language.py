from corpusflow.llm import language, queries


def test_held_out_accuracy(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.1").select(
        "doc_id", "text", "lang", language.held_out().alias("held")
    )
    content = language.fit(docs.where("not held"))
    rows = language.identify(docs.where("held"), content).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert right / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.01


def test_fit_does_not_depend_on_partitions(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    assert language.fit(docs.repartition(7)) == language.fit(docs.coalesce(1))


def test_unknown_and_close_texts(spark):
    docs = spark.createDataFrame(
        [(1, "..."), (2, None), (3, "the cat"), (4, "q")], "doc_id long, text string"
    )
    same = {"aa": b"the cat sat on the mat", "bb": b"the cat sat on the mat"}
    out = {r["doc_id"]: r for r in language.identify(docs, same).collect()}
    assert [out[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["und", "und", "aa", "aa"]
    assert all(out[k]["rejected"] and out[k]["score"] == 0 for k in out)
    assert [r["lang_pred"] for r in language.identify(docs, {}).collect()] == ["und"] * 4


def test_numbers_and_marks_are_no_letters(spark):
    texts = ["½", "² ³", "Ⅷ", "\u0301", "12", "_", "½ a", "ª", "文"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    two = {"aa": b"abba aba baab abab " * 20, "bb": b"xyz zyx yxz xzy " * 20}
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, two).collect()}
    assert [out[k] == "und" for k in range(len(texts))] == [True] * 6 + [False] * 3


def test_few_short_texts_are_rejected(spark):
    """Byte ties are broken in context: most texts of few words keep a language."""
    from pyspark.sql import functions as F

    docs = queries.documents(spark, "/root/testdata/sf0.1")
    content = language.fit(docs.where(~language.held_out()))
    n_words = F.size(F.split(F.trim("text"), r"\s+"))
    short = docs.where(F.col("text").rlike(r"\p{L}") & (n_words < 10)).withColumn("words", n_words)
    rows = language.identify(short, content).collect()
    for low, high, rejected, right in ((1, 4, 0.05, 0.26), (5, 9, 0.05, 0.9)):
        part = [r for r in rows if low <= r["words"] <= high]
        assert len(part) > 40
        assert sum(r["rejected"] for r in part) <= rejected * len(part)
        assert sum(r["lang"] == r["lang_pred"] for r in part) >= right * len(part)


def test_texts_under_a_byte_do_not_tie():
    """A word that both languages have costs less than a byte in either; the difference counts."""
    import random

    draw = random.Random(0)

    def content(letters, every):
        words = ["".join(draw.choice(letters) for _ in range(draw.randint(3, 7))) for _ in range(60)]
        return " ".join(draw.choice(words) if i % every else "no" for i in range(600)).encode()

    fixed = (("aa", content("abcdef", 7)), ("bb", content("uvwxyz", 2)))
    (best, name), (second, _) = language.sizes("No.", fixed)
    assert (best, name) == (1.0, "bb") and second > best


def test_query_never_reads_the_language_of_held_out_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    sf_dir = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf_dir)
    hidden = F.when(~language.held_out(), F.col("lang"))
    docs.withColumn("lang", hidden).write.parquet(str(tmp_path / "documents.parquet"))
    a = {r["doc_id"]: r for r in queries.op10_language(spark, sf_dir).collect()}
    b = {r["doc_id"]: r for r in queries.op10_language(spark, str(tmp_path)).collect()}
    assert a == b
