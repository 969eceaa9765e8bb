"""Wall time of a rebuild of all knowledge views from a made log of 10,000, 100,000 and 1,000,000 events; one line of JSON.

The mix of events: 40 of 100 add entities, 15 accept claims, 10 each add edges and evidence, the rest sources, families,
memberships and the life of runs.  Each size is rebuilt three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])

MIX = """CASE WHEN k < 40 THEN 'NODE_ADDED' WHEN k < 55 THEN 'CLAIM_ACCEPTED' WHEN k < 65 THEN 'EDGE_ADDED' WHEN k < 75 THEN 'EVIDENCE_LINKED' WHEN k < 80 THEN 'SOURCE_ADDED' WHEN k < 85 THEN 'FAMILY_CREATED'
 WHEN k < 90 THEN 'FAMILY_CLASSIFIED' WHEN k < 95 THEN 'RUN_STARTED' ELSE 'RUN_COMPLETED' END"""


def main(sizes: tuple[int, ...] = (10_000, 100_000, 1_000_000)) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from mossgraph.operators import knowledge, projection

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rebuild").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{folder}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for size in sizes:
        rows = spark.range(size).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(size // 4)).cast("string").alias("n"))
        body = F.to_json(F.struct(F.col("n").alias("id"), F.concat(F.lit("label "), "n").alias("label"), F.col("n").alias("family_id"), F.col("n").alias("familyId"), F.col("n").alias("entity_id"), F.col("n").alias("claimId"), F.lit("supports").alias("stance"), F.col("n").alias("fromClaimId"), F.lit("0").alias("toClaimId"), F.lit("supports").alias("relation"), F.lit("https://e.example/").alias("url")))
        log = rows.select((F.col("id") + 1).alias("seq"), F.concat(F.lit("r"), (F.col("id") % 50).cast("string")).alias("run_id"), F.expr(MIX).alias("event_type"), F.lit("t").alias("timestamp"), body.alias("payload"))
        log.write.parquet(f"{folder}/log-{size}")
        took = []
        for _ in range(3):
            began = time.perf_counter()
            events = projection.live_events(spark.read.parquet(f"{folder}/log-{size}")).persist()
            for view in (knowledge.entities, knowledge.accepted_claims, knowledge.stances, knowledge.added_sources, knowledge.families, knowledge.memberships, projection.edges):
                view(events).write.format("noop").mode("overwrite").save()
            events.unpersist()
            took.append(time.perf_counter() - began)
        times[str(size)] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "log_rebuild", "value": times[str(sizes[-1])], "unit": "sec", "events": times}))


if __name__ == "__main__":
    main()
