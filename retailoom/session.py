"""Session settings the operators are written for."""

from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffle partitions and splits skewed join partitions,
# also when splitting costs an extra shuffle afterwards.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash join instead of sorting both sides where every shuffle partition is small enough
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def configure(builder):
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: str = "8", name: str = "retailoom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = configure(SparkSession.builder.master(f"local[{cores}]").appName(name))
    spark = (
        builder.config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # no call site capture for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
