"""Thresholds of the operators, in one place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    # fixed values: the published defaults of the rules
    as_of_year: int = 2026
    min_year: int = 1950
    min_price: int = 200_000
    max_price: int = 300_000_000
    max_mileage: int = 1_000_000
    max_km_per_year: int = 100_000
    young_age: int = 4
    young_price: int = 4_000_000
    z_threshold: float = 3.5
    mad_scale: float = 0.6745
    min_group: int = 8
    repost_group: int = 5
    repost_mileage: int = 1_000
    near_market: float = 0.80
    iqr_multiplier: float = 1.5
    control_sample: int = 50
    hamming: int = 0
    price_diff: float = 0.15
    year_diff: int = 2
    stale_days: int = 2
    recheck_days: int = 7
    floor_alpha: float = 0.10
    floor_support: int = 8
    floor_max_age: int = 10
    folds: int = 5
    meaningful_text: int = 15

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        """The defaults, with what the session sets as spark.lotwise.<name>."""
        given = {f.name: spark.conf.get(f"spark.lotwise.{f.name}", None) for f in fields(cls)}
        return cls(**{name: type(getattr(cls, name))(value) for name, value in given.items() if value is not None})


def database(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """url, user and password for a JDBC source; the host and the port have defaults, anything else missing is an error."""
    host, port = env.get("POSTGRES_HOST", "localhost"), env.get("POSTGRES_PORT", "5432")
    return {"url": f"jdbc:postgresql://{host}:{port}/{env['POSTGRES_DB']}", "user": env["POSTGRES_USER"], "password": env["POSTGRES_PASSWORD"]}
