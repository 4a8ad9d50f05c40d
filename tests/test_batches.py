import pandas as pd
from pyspark.sql import functions as F

from docloom.jobs import inputs as I
from docloom.operators.sections import sections
from docloom.sources.shared import BATCH_BYTES


def test_workers_get_few_large_files_at_once(spark):
    files = spark.range(0, 30, 1, 1).select(F.lit("p").alias("package_id"), F.col("id").alias("file_ord"), F.lit("a.md").alias("path"), F.concat(F.lit("## Head\n\n"), F.expr("repeat('word ', 300000)")).alias("content"))
    found = sections(files)
    assert found.groupBy("file_ord").count().count() == 30

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [int(b.content.str.len().sum())]})

    assert max(r.n for r in files.mapInPandas(sizes, "n long").collect()) <= 2 * BATCH_BYTES


def test_narrow_rows_are_dealt_to_many_tasks(spark):
    one = spark.range(0, 1001, 1, 1)
    dealt = I.dealt(one, 100)
    assert dealt.rdd.getNumPartitions() == 11 and dealt.count() == 1001
    assert I.dealt(one.filter("id < 0"), 100).count() == 0
