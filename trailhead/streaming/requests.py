"""Requests as a stream: each file that arrives in a folder becomes a context pack."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailhead.plans import scout
from trailhead.sources import requests as rq


def stream_packs(spark: SparkSession, inbox: str, out: str, checkpoint: str, files: DataFrame | None = None, config: rq.Config | None = None) -> StreamingQuery:
    """Packs of the requests in `inbox`, as JSON in a folder of `out` for each epoch and request.

    The query's checkpoint makes a restart go on where it was, and an epoch that is run again writes
    over its own folders.
    """
    requests = spark.readStream.schema(rq.REQUEST).option("multiLine", "true").json(inbox)

    def each(batch: DataFrame, epoch: int) -> None:
        for i, row in enumerate(batch.orderBy(F.to_json(F.struct(*batch.columns))).toLocalIterator()):
            request = rq.Request.parse(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}))
            scout.run(spark, request, config, files).write.mode("overwrite").json(f"{out}/epoch={epoch}/request={i}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
