"""The leakage guard redraws until every augmentation has a clean format."""

import pytest

from promptspread.operators import augment as A
from promptspread.operators.catalogue import CASE_FNS


def test_redraws_until_clean(spark):
    pairs = spark.createDataFrame([(i, "u", "a") for i in range(6)], "conv_id long, user_text string, assistant_text string")
    spaces, separators = [" ", "  "], [": ", "- "]
    every = [f"{x}\x1f{y}\x1f{z}" for x in spaces for y in separators for z in CASE_FNS]
    banned = spark.createDataFrame([(k,) for k in every[::2]], "fmt_key string")
    rows = A.augment(pairs, 2, 5, banned, spaces, separators, "\x1f").collect()
    assert len(rows) == 12 and {r.fmt_key for r in rows} <= set(every[1::2]) and max(r.draw for r in rows) > 1
    with pytest.raises(ValueError):
        A.augment(pairs, 2, 5, spark.createDataFrame([(k,) for k in every], "fmt_key string"), spaces, separators, "\x1f")
