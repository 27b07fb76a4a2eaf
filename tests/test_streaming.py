from mealgrid.operators.rollup import top_cells
from mealgrid.plans.recommend import Recommender
from mealgrid.streaming.serve import serve_requests
from tests.fixtures import RAW, RAW_ROWS, REQUEST


def drop(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_requests_are_answered_per_batch(spark, tmp_path):
    from mealgrid.operators.clean import clean_catalogue

    recommender = Recommender(top_cells(clean_catalogue(spark.createDataFrame(RAW_ROWS, RAW))))
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in (1, 2):
        drop(spark, source, [(batch, "Goa", None, "low", None, 0.0, None)], REQUEST)
        stream = spark.readStream.schema(REQUEST).json(source)
        serve_requests(stream, recommender, out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r["batch"], r["request_id"]) for r in got.collect()) == [(0, 1), (1, 2)]


def test_staged_tables_of_a_batch_are_deleted(spark, tmp_path):
    import os

    from mealgrid.operators.clean import clean_catalogue
    from mealgrid.session import staging_root

    recommender = Recommender.build(clean_catalogue(spark.createDataFrame(RAW_ROWS, RAW)))
    folder = os.path.join(staging_root(spark).removeprefix("file://"), "mealgrid", spark.sparkContext.applicationId)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    before = len(os.listdir(folder))
    for batch in range(3):
        drop(spark, source, [(batch, "Goa", None, "low", None, 0.0, None)], REQUEST)
        serve_requests(spark.readStream.schema(REQUEST).json(source), recommender, out, check).awaitTermination()
        assert len(os.listdir(folder)) == before
    assert spark.read.parquet(out).count() == 3
