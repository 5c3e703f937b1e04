"""What the jobs' command lines share: a config file, paths as options over it, a log, and a session of their own."""

from __future__ import annotations

import argparse
import logging
import tomllib
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ctxspark.session import DEFAULTS, ensure_checkpoint_dir


def settings(description: str, paths: list[str], argv: list[str] | None = None) -> dict:
    """The config's values; --source and the like stand over them."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("config", help="TOML file")
    for name in paths:
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    with open(given.pop("config"), "rb") as file:
        return tomllib.load(file) | {k: v for k, v in given.items() if v is not None}


def main(name: str, job: Callable, values: dict) -> None:
    """Run a job in a session that ends with it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    builder = SparkSession.builder.appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        job(spark, **values)
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own among those that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
