import sys
from datetime import timedelta
from pathlib import Path

import pytest
from chat_times import EPOCH

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from chatlake.session import tune

    session = (
        SparkSession.builder.master("local[8]").appName("chatlake-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield tune(session)
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over one string column ``x``."""
    def values(inputs, expression, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]
    return values


@pytest.fixture
def chat(spark):
    """Messages from (chat_id, message_id, hours since the first of January 2024)."""
    def build(rows, user="u", contents="hi"):
        data = [(c, m, f"{user}{m % 2}", m % 2 == 0, EPOCH + timedelta(hours=h), contents) for c, m, h in rows]
        return spark.createDataFrame(
            data, "chat_id bigint, message_id bigint, user_id string, is_from_me boolean, created_at timestamp, contents string")
    return build

