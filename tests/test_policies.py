"""Policies, their hashes and the classifier that carries them."""
import math
from dataclasses import replace

import pytest

from modalframe.functions.policies import ShapeFamilyPolicy, policy_hash, policy_text, require_policy, stamp
from modalframe.operators import spatial as sp
from modalframe.operators.evidence import StrictPolicy
from modalframe.operators.pairing import ComparatorPolicy


def test_every_field_and_the_kind_of_policy_change_the_hash():
    for policy in (ComparatorPolicy(), StrictPolicy(), ShapeFamilyPolicy()):
        assert policy_hash(policy) == policy_hash(type(policy)())
        fields = policy.__dataclass_fields__
        other = {policy_hash(replace(policy, **{f: getattr(policy, f) + (2 if isinstance(getattr(policy, f), int) else 0.001)})) for f in fields}
        assert len(other) == len(fields) and policy_hash(policy) not in other
    assert policy_text(StrictPolicy()) == '{"max_relative":0.15,"min_mac":0.8,"min_observations":2,"policy":"StrictPolicy","tie_tolerance":1e-09}'
    with pytest.raises(ValueError):
        policy_text(ComparatorPolicy(min_mac=math.nan))
    for wrong in ({"parity_threshold": 1.0}, {"mirror_tolerance": True}, {"nodal_grid_points": 8}, {"nodal_grid_points": 41.0}):
        with pytest.raises(ValueError):
            ShapeFamilyPolicy(**wrong)


def test_families_carry_the_hash_and_rows_of_another_policy_are_refused(spark):
    # w = x * y is odd along both axes, w = cos(pi x) even with two nodal lines across x
    side = [i / 8 - 1 for i in range(17)]
    shapes = {1: lambda x, y: x * y, 2: lambda x, y: math.cos(math.pi * x), 3: lambda x, y: x + 1.02}
    rows = [(k, i * 17 + j, x, y, f(x, y)) for k, f in shapes.items() for i, x in enumerate(side) for j, y in enumerate(side)]
    points = spark.createDataFrame(rows, "k long, node_id long, x double, y double, w double")
    policy = ShapeFamilyPolicy(nodal_grid_points=17)
    out = sp.shape_families(points, ["k"], policy)
    got = {r.k: r for r in out.collect()}
    assert got[1].family == "Px:O|Py:O|nx:1|ny:1" and got[1].torsion
    assert got[2].family == "Px:E|Py:E|nx:2|ny:0" and not got[2].torsion
    assert got[3].parity_x == "M" and {r.policy_hash for r in got.values()} == {policy_hash(policy)}
    assert require_policy(out, policy).filter("torsion").count() == 1
    with pytest.raises(Exception, match="another policy"):
        require_policy(out, ShapeFamilyPolicy()).select("k").collect()
    with pytest.raises(ValueError):
        stamp(out, policy)
