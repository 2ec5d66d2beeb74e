from pathlib import Path

from pyspark.sql import functions as F

from quillsift.llm import common as C


def test_stage_reads_back_and_clear_deletes(spark):
    df = C.stage(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and df.columns == ["id", "x"]
    folder = Path(C.stage_dir(spark).removeprefix("file:")) / "quillsift"
    assert folder.exists()
    C.clear(spark)
    assert not folder.exists()


def test_checkpoint_dir_of_the_session_wins():
    class Session:  # the setting is fixed when a session starts
        class conf:
            @staticmethod
            def get(name, default=None):
                return "hdfs://shared/check/" if name == "spark.checkpoint.dir" else default

    assert C.stage_dir(Session) == "hdfs://shared/check"


def test_let_and_packed(spark):
    df = spark.createDataFrame([(1, "a")], "`_row` int, `x.y` string")
    assert C.packed(df).select("_row.*").columns == ["_row", "x.y"]
    assert spark.range(2).select(C.let(F.col("id") + 1, lambda v: v * v).alias("o")).collect()[1].o == 4
