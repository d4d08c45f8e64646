import zlib

from pyspark.sql import functions as F

from outreach_spark.llm import common


def test_slices_cover_all_texts_within_the_limit():
    texts = ["a" * n for n in (3, 4, 0, 9, 1, 1, 20, 0, 0)]
    got = list(common.slices(texts, 8))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))
    assert all(sum(map(len, texts[lo:hi])) <= 8 or sum(1 for t in texts[lo:hi] if t) == 1 for lo, hi in got)
    assert list(common.slices([], 8)) == [] and list(common.slices(["", ""], 8)) == [(0, 2)]


def test_folds_and_names(spark):
    df = spark.createDataFrame([(7, 1), (None, 2), (123456789, 3)], "doc_id long, __score int")
    got = {r.doc_id: r.f for r in df.select("doc_id", common.fold("doc_id", 5).alias("f")).collect()}
    assert got == {7: zlib.crc32(b"7") % 5, None: -1, 123456789: zlib.crc32(b"123456789") % 5}
    assert common.free_name(df, "score") == "__score1" and common.free_name(df, "SCORE") == "__SCORE1"


def test_tasks_can_import_the_package(spark):
    common.ship_package(spark)
    common.ship_package(spark)

    def where(batches):
        import outreach_spark.llm.common as c

        for b in batches:
            assert c.WORD_CLASS
            yield b

    assert spark.range(3).mapInArrow(where, "id long").agg(F.sum("id")).first()[0] == 3
