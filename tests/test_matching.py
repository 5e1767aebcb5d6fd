"""Word lists: the automaton against plain search, and against the built-in columns it stands in for."""

from __future__ import annotations

import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import matching, normalize, score, vocab

SHORT = st.text("abx 1", max_size=4)


def plain(words, text, bounded):
    if bounded:
        return [w for k, w in enumerate(words) if w not in words[:k] and re.search(rf"(?<![a-z]){re.escape(w)}(?![a-z])", text)]
    return [w for k, w in enumerate(words) if w not in words[:k] and w in text]


@given(st.lists(SHORT.filter(bool), max_size=8), st.text("abx 1é", max_size=30), st.booleans())
def test_words_equal_plain_search(words, text, bounded):
    known = matching.WordList(tuple(words), bounded)
    want = plain(words, text, bounded)
    assert known.found(text) == want
    assert known.first(text) == (want[0] if want else None)
    assert known.any(text) == bool(want)


def test_null_empty_and_no_words():
    assert matching.WordList(("a", "")).first("b") == "" and matching.WordList(("a", "")).first("a") == "a" and matching.WordList(("", "a")).first("a") == ""
    known = matching.WordList(())
    assert (known.found("a"), known.first("a"), known.any("a"), known.any(None), known.first(None)) == ([], None, False, None, None)


def test_ten_thousand_words_and_a_long_text(spark):
    r = random.Random(3)
    words = list(dict.fromkeys("".join(r.choice("abcde") for _ in range(r.randint(4, 9))) for _ in range(10_000)))
    texts = ["".join(r.choice("abcde ") for _ in range(60)) for _ in range(200)] + ["".join(r.choice("abcde") for _ in range(300_000)), "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", normalize.first_contained(F.col("t"), words).alias("f"), normalize.any_contained(F.col("t"), words).alias("a"), matching.contained(F.col("t"), words).alias("c")).collect()
    assert len(got) == len(texts)
    for row in got:
        t = texts[row["k"]]
        want = [w for w in words if w in t] if t is not None else []
        assert (row["f"], row["a"], row["c"]) == (want[0] if want else None, None if t is None else bool(want), want)


def test_the_fixed_lists_answer_as_built_in_expressions_do(spark):
    r = random.Random(5)
    parts = [*vocab.DETECTOR_CITIES, *vocab.PARCEL_CHAINS, *(w.lower() for w in vocab.VIRTUAL_KEYWORDS), "x", "en", "straat 1"]
    df = spark.createDataFrame([("".join(r.choice(parts) + r.choice([" ", "", "-"]) for _ in range(r.randint(0, 5))),) for _ in range(400)] + [(None,)], "t string")
    t = F.col("t")
    lists = [vocab.PARCEL_CHAINS, [w.lower() for w in vocab.VIRTUAL_KEYWORDS], [w.lower() for w in vocab.VIRTUAL_ADDRESSES]]
    native = [F.get(F.filter(normalize.literals(ws), lambda w: F.contains(t, w)), 0) for ws in lists]
    ordered = sorted(vocab.DETECTOR_CITIES, key=len, reverse=True)
    bounded = F.filter(normalize.literals(ordered), lambda w: F.regexp_like(t, F.concat(F.lit(r"(?<![a-z])\Q"), w, F.lit(r"\E(?![a-z])"))))
    left = df.select(*[normalize.first_contained(t, ws).alias(f"c{k}") for k, ws in enumerate(lists)], *[normalize.any_contained(t, ws).alias(f"a{k}") for k, ws in enumerate(lists)], F.coalesce(score._bounded(t, vocab.DETECTOR_CITIES), F.array()).alias("b"))  # noqa: SLF001
    right = df.select(*[c.alias(f"c{k}") for k, c in enumerate(native)], *[F.exists(normalize.literals(ws), lambda w: F.contains(t, w)).alias(f"a{k}") for k, ws in enumerate(lists)], F.coalesce(F.when(t.isNotNull(), bounded), F.array()).alias("b"))
    assert left.collect() == right.collect()
