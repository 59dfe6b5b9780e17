"""Report sink: a report DataFrame written with any format; failures are logged, not raised."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> bool:
    try:
        report.coalesce(1).write.mode(mode).format(fmt).option("header", "true").save(path)
        return True
    except Exception as e:  # noqa: BLE001
        log.error("the report was not saved as %s at %s: %s", fmt, path, e)
        return False
