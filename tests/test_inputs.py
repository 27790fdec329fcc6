"""Questions as models get them, and the lesser readers of answers."""

import pytest
from pyspark.sql import functions as F
from test_functions import one

from tracemill.functions import inputs as I


def test_placeholder_and_instructions(spark):
    q = lambda t: one(spark, I.with_placeholder(F.col("t")), t=t)
    assert q("a <image>\nb") == "<image>\na b" and q("a") == "<image>\na" and q("<image><image>a") == "<image><image>a" and q(None) is None
    assert one(spark, I.without_instructions(F.col("t"), (" X", " Y")), t="ask Y X") == "ask"


def choices():
    return F.array(F.lit("red car"), F.lit("blue"))


@pytest.mark.parametrize("text, letter", [("(A) or rather (B).", "B"), ("It is A", "A"), ("I think the colour must be blue here", "B"), ("red car?", None), (None, None)])
def test_multi_choice_index(spark, text, letter):
    got = one(spark, I.multi_choice_index(F.col("t"), choices(), F.lit(1)), t=text)
    assert got == letter if letter else got in ("A", "B")


def test_small_readers(spark):
    assert one(spark, I.trimmed_phrase(F.col("t")), t="The colour is a kind of blue, I think.") == "kind"
    assert one(spark, I.loose_format(F.col("t"), F.lit("B")), t="(B) x") == "B" and one(spark, I.loose_format(F.col("t"), F.lit("12")), t="(B) x") == "(B) x"
    assert one(spark, I.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3), F.lit(4)))) == 1
    assert one(spark, I.common_prefix(F.array(F.lit(1)), F.array(F.lit(1), F.lit(3)))) == 1
    assert one(spark, I.modality(F.col("i"), F.col("v")), i=(None, "array<string>"), v="") == "text"
    assert one(spark, I.choice_lines(F.col("c")), c=(None, "array<string>")) == ""
    assert tuple(one(spark, I.text_traits(F.col("t")), t="twelve bars")) == (False, True, False, False, False, False)
    assert one(spark, I.extracted(F.col("t"), F.array(F.lit("x")), F.lit("multi_choice"), F.lit("text")), t="no label") is None


def test_reward_dimensions():
    assert I.reward_dimensions('["a", 1]') == ("a", "1") and I.reward_dimensions('{"dimensions": ["x"]}') == ("x",) and len(I.reward_dimensions(None)) == 5
    with pytest.raises(ValueError):
        I.reward_dimensions('{"other": 1}')
