import random
import re

import pytest
from pyspark.sql import functions as F

from lengthlab.functions import patterns


def plain(kind, name, listed):
    for place, p in enumerate(listed):
        if kind == "rank" and re.match(rf"(.*\.)?({p})$", name):
            return place
        if kind == "skip" and (re.match(p, name) or name.endswith(p)):
            return place
        if kind in ("name", "all") and (name == p or name.endswith("." + p) or (kind == "all" and p == "*")):
            return place
    return None


def test_literals_that_a_match_must_hold():
    cases = {
        r"layers\.[0-3]\..*q_proj": "layers.", r"(a|b)*": "", r"(?:down)+_proj": "_proj", r"(abc)?x": "x", "a.b": "a", r"(mlp\.up)_x": "mlp.up_x",
        r"(?i)abc": "", "ab{0,2}c": "a", r"^model$": "model", r"x(?i:Y)z": "x", r"\d+": "", r"(?!no)yes": "yes",
    }
    for pattern, literal in cases.items():
        found = patterns.required_literal(pattern)
        assert len(found) == len(literal) and (found == literal or pattern == "ab{0,2}c"), (pattern, found)


@pytest.mark.parametrize("kind", patterns.KINDS)
def test_first_pattern_in_order_wins(spark, kind):
    rng = random.Random(kind)
    parts = ["model", "layers", "0", "1", "12", "mlp", "self_attn", "down_proj", "up_proj", "q_proj", "lm_head", "visual"]
    names = [".".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    listed = [rng.choice(parts) for _ in range(3)] + ["up_proj", "mlp.down_proj", "model.visual"]
    if kind in ("rank", "skip"):
        listed += [r"layers\.[01]\..*(q|up)_proj", r"model\.(visual|layers\.1)", r"\d+", "_proj", r"(down|up)_proj", r".*"]
    listed += ["*"] if kind == "all" else []
    rng.shuffle(listed)
    for chosen in (listed, listed[:4], []):
        df = spark.createDataFrame([(n,) for n in names] + [(None,)], "module string").withColumn("place", patterns.first_match("module", chosen, kind))
        assert {r.module: r.place for r in df.collect()} == {n: plain(kind, n, chosen) for n in names} | {None: None}


def test_stated_cases():
    rank = patterns.matcher("rank", (r"layers\.0\..*down_proj", r"layers\.0\..*_proj"))
    assert [rank(f"model.layers.{n}_proj") for n in ("0.mlp.down", "0.mlp.up", "1.mlp.up")] == [0, 1, None]
    skip = patterns.matcher("skip", ("lm_head", "model.visual", "fc1"))
    assert [skip(n) for n in ("lm_head", "model.visual.blocks.0.attn.qkv", "model.layers.3.mlp.fc1", "model.layers.3.mlp.gate_proj")] == [0, 1, 2, None]
    with pytest.raises(re.error):
        patterns.first_match(F.lit("x"), ["(a"], "rank")
