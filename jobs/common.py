"""What the jobs share: config files, folders, logging."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("axonwave.jobs")


def config_of(spark: SparkSession, path: str, known: type):
    """A JSON config, read by Spark since its path may be remote, as an instance of a dataclass; unknown names are errors."""
    return known(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; an empty one if nothing has been written there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(about: str, *paths: tuple[str, str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=about)
    for name, text in (*paths, ("config", "JSON file")):
        p.add_argument(f"--{name}", required=True, help=text)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return p.parse_args()
