"""Published model bundles: versions of a model in one shared folder, picked up by running jobs.

A version is a folder ``version=<time>-<random>`` with the saved bundle and, written after everything else, a
``manifest`` folder. Readers go by manifests alone, so that a version that is being written, or whose writer died, isn't
seen. Spark's own writer commits the manifest's file, which needs no more than any shared file system gives.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from baleprice.operators.train import RangeModelBundle

MANIFEST_SCHEMA = "version string, published_at string, bundle string, meta string"


def publish(spark: SparkSession, bundle: RangeModelBundle, root: str) -> str:
    """Saves the bundle as a new version below ``root`` and returns the version; later versions sort after earlier ones."""
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{root.rstrip('/')}/version={version}"
    bundle.save(f"{folder}/bundle")
    manifest = (version, now.isoformat(), f"{folder}/bundle", json.dumps(bundle.meta))
    spark.createDataFrame([manifest], MANIFEST_SCHEMA).coalesce(1).write.json(f"{folder}/manifest")
    return version


def latest_version(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(version, path of the bundle) of the newest manifest; None where nothing has been published yet."""
    try:
        manifests = spark.read.schema(MANIFEST_SCHEMA).json(f"{root.rstrip('/')}/version=*/manifest")
        newest = manifests.filter("version is not null").orderBy(manifests.version.desc()).select("version", "bundle").first()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return tuple(newest) if newest else None


class PublishedBundles:
    """The newest published bundle, loaded when its version is first seen."""

    def __init__(self, root: str):
        self.root, self.version, self.bundle = root, None, None

    def current(self, spark: SparkSession) -> tuple[str | None, RangeModelBundle | None]:
        """(version, bundle), both None before the first publication. A version that can't be loaded raises."""
        newest = latest_version(spark, self.root)
        if newest and newest[0] != self.version:
            self.bundle = RangeModelBundle.load(newest[1])
            self.version = newest[0]
        return self.version, self.bundle
