"""Policies as values: a canonical text, its hash, and result rows that carry both.

Any frozen dataclass of plain values is a policy. Its text names the class and its fields in sorted order, so two policies share
a hash only if every gate is the same; rows made under different gates stay apart wherever tables meet.
"""
from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def policy_text(policy) -> str:
    """One line of JSON with sorted keys; numbers that are not finite are refused."""
    if not is_dataclass(policy) or isinstance(policy, type):
        raise TypeError("a policy is an instance of a dataclass")
    return json.dumps({"policy": type(policy).__name__, **asdict(policy)}, sort_keys=True, separators=(",", ":"), allow_nan=False)


def policy_hash(policy) -> str:
    return hashlib.sha256(policy_text(policy).encode()).hexdigest()


def stamp(rows: DataFrame, policy) -> DataFrame:
    """The rows with ``policy_hash``, the hash of the policy that made them; rows that already carry one are refused."""
    if "policy_hash" in rows.columns:
        raise ValueError("these rows already carry the hash of a policy")
    return rows.withColumn("policy_hash", F.lit(policy_hash(policy)))


def require_policy(rows: DataFrame, policy) -> DataFrame:
    """The stamped rows; the first row (at run time) of another policy, or of none, ends the job."""
    same = F.coalesce(F.col("policy_hash") == policy_hash(policy), F.lit(False))
    # a filter is evaluated even where nothing reads the column
    return rows.filter(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("row of another policy: "), F.coalesce("policy_hash", F.lit("none")))).cast("boolean")))


@dataclass(frozen=True)
class ShapeFamilyPolicy:
    """Gates of the surface-shape classifier (fixed values)."""

    parity_threshold: float = 0.80
    mirror_tolerance: float = 0.02
    minimum_mirror_coverage: float = 0.95
    near_square_tolerance: float = 0.05
    nodal_grid_points: int = 41
    nodal_amplitude_floor: float = 0.05

    def __post_init__(self):
        shares = {k: v for k, v in asdict(self).items() if k != "nodal_grid_points"}
        wrong = [k for k, v in shares.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 < v < 1]
        if type(self.nodal_grid_points) is not int or self.nodal_grid_points < 9:
            wrong.append("nodal_grid_points")
        if wrong:
            raise ValueError("out of range: " + ", ".join(wrong))
