"""What the jobs' command lines share: a JSON file of settings, overridden by options, and a session."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def load(path: str, known: dict) -> dict:
    """Settings of a JSON file over the defaults ``known``; an unknown name is an error."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return known | given


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the write that made them ends, not when the driver's collector gets to them; the setting is restored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def command_line(job: Callable[..., dict], known: dict, config: str, about: str, argv: list[str] | None = None) -> int:
    """Run ``job`` with the settings of --config and the options given; creates and stops the session."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=config, help="JSON file of settings")
    for name, value in known.items():
        kind = type(value) if isinstance(value, int) else str
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, type=kind)
    options = vars(parser.parse_args(argv))
    settings = load(options.pop("config"), known) | {k: v for k, v in options.items() if v is not None}
    missing = sorted(k for k, v in settings.items() if v == "")
    if missing:
        parser.error(f"set {', '.join(missing)} in the configuration or as options")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        job(spark, **settings)
    finally:
        spark.stop()
    return 0
