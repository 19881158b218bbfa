import zlib

from pyspark.sql import functions as F

from retailoom.llm import langid
from retailoom.llm.common import read


def test_held_out_accuracy(spark):
    table = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.query(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    total, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert total > 100 and right >= 0.95 * total


def test_odd_rows(docs, rows):
    got = langid.query(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (500, 501, 502))
    assert by_id[400].lang_pred == "en"


def test_spans_and_scripts(spark):
    rows = [(i, "the house and the garden of the king", "en") for i in range(20)]
    rows += [(20 + i, "der garten und das haus von dem koenig", "de") for i in range(20)]
    rows += [(40 + i, "дом и сад", "ru") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    mixed = "the garden of the king and the house " * 3 + "das haus und der garten von dem koenig " * 2 + "12 . сад дом и сад " * 2
    asked = spark.createDataFrame([(1, mixed), (2, "ж"), (3, "1234 --")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert got[1].lang_pred == "en" and [s.split(":")[0] for s in got[1].spans.split()] == ["en", "de", "ru"]
    assert got[2].lang_pred == "ru" and got[3].lang_pred == "und"


def test_no_rows(docs, no_docs):
    assert langid.query(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.query(unlabelled).collect()} == {"und"}
