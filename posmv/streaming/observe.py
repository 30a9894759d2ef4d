"""Progress of streaming queries as JSON lines: rates, lag and counters that were observed on the way."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def metered(raw: DataFrame, name: str, value: str = "value") -> DataFrame:
    """raw with records, bytes and malformed lines counted for each batch."""
    return raw.observe(name, F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("bytes"), F.count_if(F.get_json_object(value, "$").isNull()).alias("malformed"))


class Progress(StreamingQueryListener):
    """Appends a line for each batch of each query to a file on the driver."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        self._write({"event": "started", "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        self._write({
            "event": "progress", "name": p.name, "batch": p.batchId, "input_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond,
            "batch_ms": p.batchDuration, "state_rows": sum(s.numRowsTotal for s in state), "late_rows": sum(s.numRowsDroppedByWatermark for s in state),
            "observed": {k: v.asDict() for k, v in (p.observedMetrics or {}).items()},
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write({"event": "terminated", "exception": event.exception})

    def _write(self, line: dict) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(line, default=str) + "\n")
