from fernglass.plans import shared
from pyspark.sql import functions as F


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What led to the files is not kept on disk until the driver collects its garbage; settings stay as they were."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    counts = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = {f.getName() for f in _each(held.getAllFiles())}, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    written = shared.cut(counts.join(spark.range(50).select(F.col("id").alias("k")).repartition(3, "k").hint("merge"), "k"))
    after = {f.getName() for f in _each(held.getAllFiles())}
    assert not [f for f in after - before if f.startswith("shuffle_")] and written.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting and counts.count() == 7


def _each(files):
    at = files.iterator()
    while at.hasNext():
        yield at.next()


def test_a_grown_heap_is_given_back(spark, monkeypatch):
    factory = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    full = lambda: sum(b.getCollectionCount() for b in factory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(shared, "_HEAP", 1 << 20, raising=False)
    before = full()
    shared.cut(spark.range(5))
    assert full() > before
