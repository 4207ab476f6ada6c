"""Made-up prose and brute-force versions for the operators' tests."""

import contextlib
import random


def prose(seed, n, vocabulary=3000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", {}).get(i), columns.get("source", {}).get(i, f"src{i % 7}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return frame(spark, rows)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def split_joins(spark):
    """Makes Spark split partitions of a few kilobytes; gives a function that counts the joins that it has split since."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {k: spark.conf.get(k, None) for k in SKEW}
    begun = store.executionsCount()

    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.executionsList()
        return [every.apply(i).physicalPlanDescription() for i in range(int(begun), every.size())]

    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        yield lambda: sum("skew=true" in p for p in plans())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
