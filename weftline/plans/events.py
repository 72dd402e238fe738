"""Windows over event time, in the batch form of the streaming operators (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import live
from ._pairs import Pairs

PAIRS = Pairs()


@PAIRS.add("""SELECT time_bucket(INTERVAL 10 minutes, ts) AS start, time_bucket(INTERVAL 10 minutes, ts) + INTERVAL 10 minutes AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.windowed_counts(e, "ts", "event_type")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@PAIRS.add("""WITH o AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 15 minutes OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL 15 minutes AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.sessions(e, "ts", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
