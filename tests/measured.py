"""What tests measure of a session."""


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
