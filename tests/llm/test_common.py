from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.llm import common
from tests.llm.helpers import docs_of


def test_staged_tables_lie_in_the_shared_folder_and_can_be_dropped(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    made = common.staged(docs_of(spark, ["a", None]), "mine")
    assert made.count() == 2 and list(shared.glob("quillon-mine-*"))
    common.drop_scratch(spark)
    assert not list(shared.glob("quillon-*"))


def test_scratch_since_a_mark_is_dropped_but_for_the_last(spark):
    kept, mark = common.staged(docs_of(spark, ["a"]), "before"), common.scratch_mark()
    common.staged(docs_of(spark, ["b"]), "inner")
    last = common.staged(docs_of(spark, ["c"]), "last")
    common.drop_scratch(spark, since=mark, but=1)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert kept.count() == last.count() == 1 and not list(shared.glob("quillon-inner-*"))


def test_no_machine_local_folder_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_clashing_names(spark):
    df = spark.range(1).selectExpr("1 AS Score", "2 AS `a.b`", "3 AS text")
    assert common.without(df, "score").columns == ["a.b", "text"]


def test_words(spark):
    text = "a\tb\x0bc d  \r\n e "
    row = spark.createDataFrame([(text,)], "t string").select(common.words_of(F.col("t")).alias("w"), common.word_count(F.col("t")).alias("n")).first()
    assert row.n == 4 and row.w == ["a", "b", "c d", "e"]
