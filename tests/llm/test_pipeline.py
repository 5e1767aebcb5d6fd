"""The pipeline's stages on odd and empty rows, and the whole run against what its stages promise."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, component_id string"


def text(seed, n, words="ababa cadec defgi fighu hijok lomun nopaq rusat tuvax wyzeb".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice("aeiou") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """200 documents of which a fifth swear, one in seven is junk, some are copies; and the odd ones."""
    r, rows, labels = random.Random(1), [], []
    for k in range(200):
        toxic, poor = k % 5 == 0, k % 7 == 3
        body = "#### $$$$ 0000 ## $$ %% " * 20 if poor else text(k if k % 11 else 0, 60)
        rows.append((k, body + (" you zorkface zorkfaces, vile zorkface" if toxic else ""), "en", r.choice("aab"), 1, "x", "y", "z"))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(900, None, None, None, None, "x", "y", "z"), (901, "", "en", "a", 0, "x", "y", "z"), (None, text(901, 60), "en", None, 1, "x", "y", "z"), (902, text(902, 20_000), "en", "b", 1, "x", "y", "z"), (5, rows[5][1], "en", "a", 1, "x", "y", "z")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_on_odd_and_on_empty_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = stage(spark, docs, sf)
    rows = got.collect()
    assert rows
    if name != "pack":
        assert got.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    else:
        assert sum(r["length"] for r in rows if r["doc_id"] == 901) == 1
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_the_run_keeps_what_its_stages_keep(spark, sf):
    """Toxic, poor and repeated documents go, clean ones are packed whole."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    packed = {r["doc_id"] for r in pieces}
    toxic, poor = {k for k in range(200) if k % 5 == 0}, {k for k in range(200) if k % 7 == 3}
    clean = {k for k in range(200) if k % 11} - toxic - poor
    assert not packed & toxic and not packed & poor and clean <= packed and 902 in packed
    copies = [k for k in range(0, 200, 11) if k in packed]
    assert len(copies) == 1 and docs[copies[0]] == text(0, 60)
    for k in clean:
        parts = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == k)
        assert sum(n for _, n, _ in parts) % parts[0][2] == 0


def test_near_dedup_follows_fingerprints_and_similar_sets(spark):
    """1 and 2 have fingerprints within two bits but few equal shingles; 2 and 3 the other way round; 4 stands alone."""
    from ledgerlens.llm import simhash

    loop = "een twee drie vier vijf " * 400
    tail = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    rows = [(1, loop + tail(1)), (2, loop + tail(2)), (3, "een twee drie vier vijf " * 2 + tail(2)), (4, tail(4)), (None, tail(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    apart = lambda a, b: bin((simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])) & (2**64 - 1)).count("1")
    assert apart(0, 1) <= 2 < apart(1, 2)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect() if r["doc_id"]) == [1, 2, 4]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == ["1", "4", "None"]
