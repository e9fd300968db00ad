"""The driver contract."""

import __spark_entry__ as entry


def test_entry_and_keys(spark):
    df = entry.entry(spark)
    assert df.columns == ["analysis_id", "outer_minutes", "poi_count"] and df.count() == 75
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_folder(spark):
    import pytest

    from reachlake import lineage

    before = spark.conf.get("spark.checkpoint.dir")
    assert lineage.scratch(spark, "x").startswith(before)
    d = lineage.keep(spark.range(5).toDF("id"), "five")
    assert d.count() == 5
    lineage.clean(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(d.inputFiles()[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    class Cluster:
        """A session of a cluster that names no shared folder."""

        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="checkpoint"):
        lineage.scratch(Cluster, "x")
