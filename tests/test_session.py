"""Session defaults and the shared checkpoint folder."""

from loadlens.session import checkpoint_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    path = checkpoint_dir(spark)
    assert path and spark.conf.get("spark.checkpoint.dir") == path
    assert spark.sparkContext.getCheckpointDir() is not None


def test_session_defaults(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.ui.enabled") == "false"


def test_reliable_checkpoint_cuts_lineage(spark):
    checkpoint_dir(spark)
    df = spark.range(0, 100).selectExpr("id", "id * 2 AS twice")
    cut = df.checkpoint()                      # written under the shared folder, not local
    assert cut.count() == 100
    assert "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()
