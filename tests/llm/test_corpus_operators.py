"""The corpus operators against brute force, and on odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import capfilters, contextmix, langid, mainhtml, mixing, packing, quality, rules, simhash, toxicity
from ledgerlens.llm.common import is_fold
from ledgerlens.llm.training import hashed_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, signature string"


def words(seed: int, n: int, alphabet: str = "abcdefgh") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, ids and sources, repeated rows, a very long text, clashing column names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "b"), (5, words(1, 120), "en", "a"), (5, words(1, 120), "en", "a"), (None, words(2, 60), "de", None), (6, words(3, 30_000), "de", "b"), (7, words(1, 120), "en", "b"), (8, "日本語 テキスト 👍", "xx", "c")]
    return spark.createDataFrame([(i, t, lang, s, 1, "x", "y", "z") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (5, 1, 1), (5, None, 1), (6, 0, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_prints_and_spark_hash(spark):
    for t in [None, "", "A b", "x y z", words(4, 200), "ÄB äb ÄB äb"]:
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_print(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_covering_masks_catch_every_pair_within_the_radius():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(2)]
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


@pytest.mark.parametrize("limit", [64, 2])
def test_simhash_links_equal_brute_force(spark, limit):
    r = random.Random(limit)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(20)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), pair_limit=limit)
    from ledgerlens.operators.components import connected_components

    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_simhash_on_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == comp[7] == 5
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 8), (True, 0)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_stage_groups_equal_brute_force_at_the_similarity(spark):
    r, texts = random.Random(11), []
    for base in range(25):  # edits anywhere, enough of them to lie on both sides of 0.8
        w = words(base + 500, 200).split()
        texts.append(" ".join(w))
        for k in range(4):
            x = list(w)
            for at in r.sample(range(200), 2 * k + 1):
                x[at] = f"edit{r.random()}"
            texts.append(" ".join(x))
    chain = words(999, 300).split()
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 100, 9)]
    texts += [" ".join(w for at, w in enumerate(chain) if at != k) for k in range(90)]  # a crowd of near copies
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    found = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                found += len(sets[a] & sets[b]) < len(sets[a] | sets[b])
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    assert found > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (simhash.TILE, 16):  # in one block, and dealt over blocks
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, tile=tile).collect()} == dict(enumerate(group))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(group))
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_counts(text):
    w = [x.decode() for x in (text or "").encode().split()]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark):
    for t in [None, "", "a b c", "a b c a b c d", "x | y\nx | y\n\n ## z", "é é é é é", words(9, 90, "ab") + "\n" + words(9, 90, "ab")]:
        assert rules.counts(t) == brute_counts(t)


def test_rules_reject_outliers_and_keep_the_rest(spark, odd):
    rows = [(i, words(i, 150 + i % 40), "en", f"s{i % 2}") for i in range(300)] + [(1000 + i, " ".join(x + "###" for x in words(i, 150).split()), "en", "s0") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(5)) and sum(got[i] for i in range(300)) >= 297
    assert rules.judged(odd).count() == 10 and rules.judged(odd.limit(0)).count() == 0


def test_rules_reject_repeated_lines_but_not_one(spark):
    line = lambda i, k: words(7_000 + 100 * i + k, 4 if k < 6 else 16)
    text = lambda i, n, dup: "\n".join([line(i, k) for k in range(n - dup)] + [line(i, k) for k in range(dup)])
    rows = [(i, text(i, 16 + i % 8, 0), "en", "s") for i in range(300)] + [(1000 + i, text(500 + i, 20, 6), "en", "s") for i in range(5)]
    rows += [(2000 + i, text(600 + i, 20, 1), "en", "s") for i in range(5)]
    rows += [(3000 + i, words(9_000 + i, 200) + " " + " ".join([words(9_500 + i, 10)] * 6), "en", "s") for i in range(5)]
    got = {r["doc_id"]: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not any(got[k + i]["kept"] for k in (1000, 3000) for i in range(5))
    assert all(got[2000 + i]["kept"] for i in range(5)) and sum(got[i]["kept"] for i in range(300)) >= 297


def test_determinant_is_robust(spark):
    """A quarter of wild rows moves the plain mean, not the estimate."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 5)), rng.normal(30, 1, (60, 5))])
    rows = spark.createDataFrame([(i, "g", *map(float, r)) for i, r in enumerate(x)], "doc_id long, group string, " + ", ".join(f"{c} double" for c in rules.STATISTICS))
    est = rules.robust_estimates(rows).first()
    assert all(abs(est[f"m{i}"]) < 0.4 for i in range(5)) and abs(x.mean(axis=0)).min() > 4


def test_determinant_equals_the_least_of_all_subsets(spark):
    """Nine rows of twelve, three of them wild: the steps end in the subset that 220 trials name; steps from any end lower nothing."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    groups = {g: np.vstack([rng.normal(0, 1, (9, 5)), rng.normal(25 + 5 * g, 1, (3, 5))]) for g in range(4)}
    rows = [(i, str(g), *map(float, r)) for g, x in groups.items() for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "doc_id long, group string, " + ", ".join(f"{c} double" for c in rules.STATISTICS))
    got = {r["group"]: r for r in rules.determinants(frame).collect()}
    floors = np.diag(np.square(rules.FLOORS))
    for g, x in groups.items():
        least = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + floors)[1] for c in combinations(range(12), 9))
        assert got[str(g)]["n"] == 9 and abs(got[str(g)]["log_det"] - least) < 1e-9


def test_small_groups_have_their_own_estimate(spark):
    """A group of eight rows rejects its wild row, keeps rows of its own habit, and differs from the estimate of all rows."""
    rows = [(i, words(i, 150 + i % 40), "en", "s") for i in range(300)] + [(500 + i, words(800 + i, 150 + i), "en", "small") for i in range(7)]
    rows += [(600, " ".join(x + "###" for x in words(900, 150).split()), "en", "small")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own, pooled = ({r["doc_id"]: r for r in rules.judged(frame, prior_rows=k).collect()} for k in (50.0, 1e12))
    assert not own[600]["kept"] and all(own[500 + i]["kept"] for i in range(7))
    assert all(abs(own[500 + i]["distance"] - pooled[500 + i]["distance"]) > 1e-6 for i in range(7))


def test_mixing_bisection_and_budget(spark):
    rows = [(i, " ".join(["w"] * (10 + i % 5)), None, "big" if i < 300 else f"s{i % 3}") for i in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shown = mixing.schedule(docs, max_repeat=3.0).collect()
    tokens, first = {}, {}
    for r in shown:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
        first[r["doc_id"]] = first.get(r["doc_id"], 0) + 1
    size = {s: sum(10 + i % 5 for i, _, _, x in rows if x == s) for s in tokens}
    assert len(first) == 360, "every document is shown"
    share = np.array([size[s] for s in size]) / sum(size.values())
    t = shown[0]["exponent"]
    w = dict(zip(size, share**t / (share**t).sum(), strict=True))
    budget = max(size[s] / w[s] for s in size)
    repeat = max(w[s] * budget / size[s] for s in size)
    entropy = -sum(x * np.log(x) for x in w.values())
    assert repeat <= 3.0 + 1e-6
    assert abs(repeat - 3.0) < 1e-6 or abs(entropy - mixing.ENTROPY_SHARE * np.log(4)) < 1e-6
    for s in size:
        assert -1e-6 <= w[s] * budget - tokens[s] < 15, "the quota is met but for less than a document"


def test_mixing_on_odd_rows(spark, odd):
    assert mixing.schedule(odd).select("doc_id").distinct().count() == 9
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert mixing.schedule(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0
    cut = mixing.schedule(odd.where("text is not null"), budget=500).agg(F.sum("n_tokens")).first()[0]
    assert cut <= 500


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.9
    np.fill_diagonal(c, False)
    return c


@pytest.mark.parametrize("tile", [1024, 8])
def test_caps_equal_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((25, 32))
    x = np.vstack([c + 0.15 * rng.standard_normal((8, 32)) for c in centres] + [rng.standard_normal((100, 32)), centres[:3], centres[:3]]).astype(np.float32).astype(np.float64)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, []), (904, [None] * 32), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (None, rows[0][1])]
    got = {r["vec_id"]: r for r in capfilters.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), tile=tile).collect()}
    want = brute_links(x)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= want.sum() and found >= 0.97 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902, 903, 904)) and got[905]["n_links"] == got[906]["n_links"] == 1
    assert len(got) == len(x) + 8
    assert capfilters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cap_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2, 800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    z = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    d, met = capfilters.directions_for(50_000), np.zeros(800, bool)
    for k in range(capfilters.CODES):
        (a, fa), (b, fb) = capfilters.decode(x, k, d), capfilters.decode(z, k, d)
        met[np.intersect1d(a * d * d + fa, b * d * d + fb) // (d * d)] = True
    assert met.mean() >= 0.95


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library(vocabulary):
    from tokenizers import Tokenizer

    model, own, r = Tokenizer.from_file(vocabulary), packing.TextTokenizer(vocabulary), random.Random(3)
    parts = [" ", "  ", "\n", "a", "B1", "don't", "é", "...", "<|endoftext|>", "日本", "👍", "12", "|", "\t", "\xa0", " ", "\r\n", "\0", "\x1c"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids
    assert len(own.encode("a" + " " * 1_500_000 + "b")) > 4


def check_packing(got, want):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        assert sum(r["length"] for r in rows) <= 1024
    assert sum(r["length"] for r in got) == sum(map(len, want))
    return len(by)


def test_packing_round_trip(spark, odd, vocabulary):
    own = packing.TextTokenizer(vocabulary)
    ids = {r["doc_id"]: np.append(np.frombuffer(own.encode(r["text"] or ""), "<u4"), 0).astype("<u4") for r in odd.collect()}
    got = packing.packed(odd, vocabulary).collect()
    check_packing(got, [*ids.values(), ids[5]])
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert packing.packed(odd.limit(0), vocabulary).count() == 0


def test_bm25_order_equals_brute_force():
    r = random.Random(12)
    pieces = [np.array([r.randrange(12) for _ in range(r.randint(1, 40))], np.uint16) for _ in range(30)]
    grams = [[(int(a), int(b)) for a, b in zip(x, x[1:])] if len(x) > 1 else [(int(x[0]),)] for x in pieces]
    index, mean = packing.ShardIndex(pieces), np.mean([len(g) for g in grams])
    for seed in range(30):
        score = np.zeros(30)
        for term in set(grams[seed]):
            df = sum(term in g for g in grams)
            for i, g in enumerate(grams):
                if df > 1 and term in g:
                    tf = g.count(term)
                    score[i] += np.log1p((30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(g) / mean))
        found = index.neighbours(seed).tolist()
        assert sorted(found) == np.flatnonzero(score).tolist() and score[found] == pytest.approx(np.sort(score[score > 0])[::-1])


def test_bm25_finds_the_lexical_neighbour_and_fills(spark):
    rng = np.random.default_rng(0)
    pieces = [rng.integers(0, 5_000, 400).astype(np.uint16) for _ in range(20)]
    pieces[7] = np.concatenate([pieces[3][:300], pieces[7][:100]])
    assert packing.ShardIndex(pieces).neighbours(3)[0] in (3, 7) and 7 in packing.ShardIndex(pieces).neighbours(3)[:2]
    sequences = packing.pack_shard(pieces)
    assert sum(n for s in sequences for _, _, n in s) == 8_000 and sum(sum(n for *_, n in s) < 1024 for s in sequences) <= 1


def toxic_rows(n, seed=0):
    out = []
    for i in range(n):
        w, bad = words(seed + i, 80).split(), i % 5 == 0
        if bad:
            w[10:10] = ["zorkle", "zorkish"]
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_held_out():
    rows = toxic_rows(400)
    s = toxicity.Scorer([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    held = toxic_rows(100, 10_000)
    p = s.score([t for _, t, _ in held] + [None, ""], toxicity.WordEvidence(s.models))
    found, truth = p[:100] >= 0.3, np.array([y for *_, y in held]) == 1
    assert found[truth].all() and found[~truth].sum() <= 2 and p[100] == p[101] < 0.3


def test_kneser_ney_is_a_distribution():
    from collections import Counter

    m = toxicity.ClassModels(Counter(["abc", "abd", "b"]), Counter(["abc", "acd", "cab"]))
    grams = [("\x02" * 4 + "ab")[-5:][1:] + c for c in "abcd\x03"]
    x = np.array([[ord(c) for c in g] for g in grams], np.uint32)
    p = np.full(5, 1e-5)
    for width, (part, left) in enumerate(m.shared, 1):
        tail = x[:, toxicity.ORDER - width :]
        p = part.get(toxicity._key(tail)) + left.get(toxicity._key(tail[:, :-1]), 1.0) * p
    assert 0.95 < p.sum() <= 1  # what is left is for characters never seen


def test_classifiers_on_odd_rows(spark, odd, labels):
    for module in (toxicity, quality):
        model = module.fit(odd, labels)
        got = odd.select("doc_id", module.score(odd, model).alias("p")).collect()
        assert len(got) == 10 and all(0 <= r["p"] <= 1 for r in got)
        nothing = module.fit(odd, labels.limit(0))
        assert odd.select(module.score(odd, nothing).alias("p")).distinct().collect()[0]["p"] == 0.0


def test_quality_held_out_and_gradient():
    rows = [(words(i, 150), 1) for i in range(150)] + [(" ".join(x + "###" for x in words(i, 150).split()), 0) for i in range(60)]
    m = quality.train([t for t, _ in rows], np.array([y for _, y in rows]))
    p = m.score([words(900, 200), " ".join(x + "&&&" for x in words(901, 200).split())])
    assert p[0] > 0.7 and p[1] < 0.3
    net, rng = quality.Attention(5), np.random.default_rng(0)
    x, bag, y = rng.standard_normal((7, 5)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -(y * np.log(f := net.forward(x, bag, 3)["p"]) + (1 - y) * np.log(1 - f)).mean()
    g = net.gradients(net.forward(x, bag, 3), bag, y)
    for k in ("E", "V", "U", "a", "o"):
        at = tuple(0 for _ in net.w[k].shape)
        net.w[k][at] += 1e-6
        up = loss()
        net.w[k][at] -= 2e-6
        down = loss()
        net.w[k][at] += 1e-6
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_field_inference_is_exact():
    f = langid.Field([words(i, 60, "abcde") for i in range(30)] + [words(i, 60, "vwxyz") for i in range(30)], ["p"] * 30 + ["q"] * 30)
    text = words(77, 70, "abcde") + " " + words(78, 40, "vwxyz")
    w = langid.words_of(text)
    e, t = f.potentials(w), np.exp(f.log_transfer)
    m, _ = langid.forward_backward(e[None], t)
    got = langid.Labeller(f).counts([text, None, words(79, 500, "abcde")])
    assert got[0] == pytest.approx(m[0].sum(axis=0), abs=1e-4) and got[1].sum() == 0
    p = np.exp(e[:3] - e[:3].max(axis=1, keepdims=True))  # three words, all labellings
    joint = np.zeros((2, 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                joint[a, b, c] = t[:, a].mean() * p[0, a] * t[a, b] * p[1, b] * t[b, c] * p[2, c]
    joint /= joint.sum()
    assert langid.forward_backward(e[None, :3], t)[0][0, 0] == pytest.approx(joint.sum(axis=(1, 2)), abs=1e-9)
    names, scores = langid.Labeller(f).label([text, None, "123 ² !", words(80, 30, "vwxyz")])
    assert names == ["p", "und", "und", "q"] and scores[1] == scores[2] == 0 and m[0][:60, 0].mean() > 0.9 and m[0][-30:, 1].mean() > 0.9


def test_langid_on_odd_rows(spark, odd):
    got = odd.select("doc_id", langid.label(odd, langid.fit(odd)).alias("l")).collect()
    assert {r["doc_id"]: r["l"]["lang_pred"] for r in got}[1] == "und"
    none = langid.fit(odd.where("lang is null"))
    assert {r[0] for r in odd.select(langid.label(odd, none)["lang_pred"]).collect()} == {"und"}


def test_context_mixing(spark, odd):
    rows = [(i, words(i % 150, 80), None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    held = is_fold(F.col("doc_id"), 7, 2)
    got = {r["doc_id"]: r for r in contextmix.score(docs, held, chunk_tokens=5_000).collect()}
    train = [w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in contextmix.tokens_of(t)]
    from collections import Counter

    c = Counter(train)
    for i, t, *_ in rows[:40]:
        tokens = contextmix.tokens_of(t)
        base = sum(np.log10((c[w] + 1) / (len(train) + len(c) + 1)) for w in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), len(train))
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0
    out = contextmix.score(odd, is_fold(F.col("doc_id"), 7, 2))
    assert out.count() == 10 and out.where("doc_id = 1").first()["n_tokens"] == 1
    assert contextmix.score(odd.limit(0), held).count() == 0


def test_context_mixing_scores_one_unbroken_token(spark):
    r = random.Random(21)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    rows = [(i, words(i, 80)) for i in range(40)] + [(1000, long), (1001, words(3, 20) + " " + long + " " + words(4, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in contextmix.score(docs, F.col("doc_id") >= 1000).collect()}
    assert np.isfinite(list(got.values())).all() and got[1000] < -65_520 and got[1001] < got[1000]


def test_context_mixing_states_equal_brute_force():
    """Every state is counted anew from all triples that share its context and leading bits."""
    r = random.Random(8)
    vocabulary = [contextmix.hash32(words(k, 1).encode()) for k in range(40)]
    triples = {(r.choice(vocabulary[:6]), r.choice(vocabulary[:3]), r.choice(vocabulary)): r.randint(0, 3) for _ in range(150)}
    one, two, now = (np.array([t[k] for t in triples], np.uint64) for k in range(3))
    n, held, before = np.array(list(triples.values())), np.array([r.random() < 0.3 for _ in triples]), two >> np.uint64(20)
    cells = contextmix.Cells(np.bincount((now >> np.uint64(24)).astype(int), weights=n, minlength=256).astype(int), 3)
    key = one << np.uint64(32) | now >> np.uint64(24) << np.uint64(24) | before
    got = contextmix.coded(contextmix.Router({}, 1).context(key), key, n, held, cells)
    order = sorted(range(len(n)), key=lambda i: (int(one[i]), int(before[i]), int(now[i])))
    o, t, w, c = [int(one[i]) for i in order], [int(before[i]) for i in order], [int(now[i]) for i in order], [int(n[i]) for i in order]
    mix, logs, held_logs, used = contextmix.Gated(64, 3, 8), np.zeros(len(w)), np.zeros(len(w)), held[order]
    there = set(range(len(w)))
    for k in range(8):
        bit = np.array([x >> (31 - k) & 1 for x in w])
        same = [lambda i, j: True, lambda i, j: o[i] == o[j], lambda i, j: (o[i], t[i]) == (o[j], t[j])]
        peers = lambda i, f: [j for j in range(len(w)) if f(i, j) and w[j] >> (32 - k) == w[i] >> (32 - k)]  # noqa: B023, E731
        for i in sorted(there):  # no other training token shares context and bits: cell counts alone
            rows = peers(i, same[1])
            if sum(c[j] for j in rows) <= (not any(used[j] for j in rows)):
                there.discard(i)
                for own, sums in ((1, logs), (0, held_logs)):
                    for m in range(k, 8):
                        side = [sum(c[j] for j in range(len(w)) if w[j] >> (31 - m) == w[i] >> (31 - m) ^ flip) for flip in (0, 1)]
                        own_ = min(own, side[0])
                        sums[i] += np.log((side[0] - own_ + 0.4) / (side[0] + side[1] - own_ + 0.8))
        rows_ = sorted(there)
        if not rows_:
            break

        def inputs(out, some):
            seen = []
            for f in same:  # noqa: B023
                x = [[sum(c[j] for j in peers(i, f) if bit[j] == v) - (out and bit[i] == v and c[i] > 0) for v in (0, 1)] for i in some]  # noqa: B023
                seen.append(np.array(x, np.float32))
            cf = [np.minimum(np.floor(np.log2(x.sum(axis=1) + 1)), 7).astype(int) for x in seen]
            return [np.log((x[:, 1] + 0.4) / (x[:, 0] + 0.4)) for x in seen], cf[1] * 8 + cf[2], cf[2], bit[some]  # noqa: B023

        cut = len(rows_) // contextmix.RUN * contextmix.RUN  # whole runs are coded and learned from before what is left
        for some in filter(len, (rows_[:cut], rows_[cut:])):
            held_logs[some] += mix.log(*inputs(False, some))
            logs[some] += mix.online(*inputs(True, some), np.array(c, np.float32)[some])
    trains = np.array(c) > 0
    assert got[0][order][trains] == pytest.approx(logs[trains] / np.log(10), abs=1e-4)
    assert got[1][order][used] == pytest.approx(held_logs[used] / np.log(10), abs=1e-4)
    assert len(there) > 20 and len(there) < len(w)


@pytest.mark.parametrize("n_words", [12, 1 << 60])
def test_context_mixing_finds_what_a_text_repeats(n_words):
    r = random.Random(3)
    texts = [[r.randrange(12) for _ in range(r.randint(1, 30))] for _ in range(20)]
    at, earlier = contextmix.repeats(np.repeat(np.arange(20), [len(t) for t in texts]), np.concatenate(texts).astype(np.int64), n_words)
    brute = [t[:i].count(w) for t in texts for i, w in enumerate(t)]
    assert dict(zip(at.tolist(), earlier.tolist(), strict=True)) == {i: n for i, n in enumerate(brute) if n}


def test_context_mixing_numbers_words_and_contexts():
    pieces = [[b"b", b"a", b"b"], [], [b"c", b"a", b"\xff"]]
    found, numbers = contextmix._numbered([contextmix._listed(x) for x in pieces])
    assert found == [b"b", b"a", b"c", b"\xff"] and [[found[i] for i in x] for x in numbers] == pieces
    for key in ([], [5], [1, 1, 2, 9], [7, 2, 7, 2**63, 0, 2]):
        first, which = contextmix._ranks(np.array(key, np.uint64))
        assert [key[i] for i in first] == sorted(set(key)) and [key[first[i]] for i in which] == key
    cell = contextmix.MOST_BITS
    keys = sorted({(c << cell) | w for c in (0, 3, 2**44 - 1) for w in (0, 1, 5, 2**19, 2**20 - 1)})
    got = contextmix._parted(np.array(keys, np.uint64))
    for k in range(cell + 1):  # groups of keys that share the context and k leading bits
        assert (got <= k).tolist() == [i == 0 or keys[i] >> (cell - k) != keys[i - 1] >> (cell - k) for i in range(len(keys))]


def test_context_mixing_counts_byte_states_like_a_loop():
    listed, total = [words(k, 1).encode() for k in range(300)] + [contextmix.END], np.zeros((2, contextmix.SLOTS), np.float32)
    contextmix.states(listed, total)
    s, brute = contextmix.Spelling(listed), np.zeros(2 * contextmix.SLOTS)
    for k in range(8):
        node, bit = s.bit(k)
        for o in range(len(contextmix.ORDERS)):
            for at, n in zip((s.slot(o, node) + bit * contextmix.SLOTS).tolist(), s.uses.tolist(), strict=True):
                brute[at] += n
    assert np.array_equal(total.ravel(), brute) and total.dtype == np.float32
    assert s.uses.sum() == sum(len(w) + (w != contextmix.END) for w in listed)


def test_texts_are_a_distribution(spark):
    """The probabilities of different held-out texts add up to less than one, known words or not."""
    train = [(k, words(k % 7, 12)) for k in range(40)]
    known = sorted({w for _, t in train for w in t.split()})
    texts = ["", *known, *"abcdefghij", *[f"{a} {b}" for a in known[:12] for b in known[:12]], *[x + y for x in "abc" for y in "abc"]]
    rows = train + [(1000 + k, t) for k, t in enumerate(dict.fromkeys(texts))]
    got = contextmix.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).where("held_out").collect()
    p = {r["doc_id"]: 10 ** r["score"] for r in got}
    assert len(p) == len(rows) - 40 and sum(p.values()) <= 1
    first = {t.split()[0] for _, t in train}
    beginning = [p[1001 + known.index(w)] for w in first]
    assert min(beginning) > np.mean([p[1001 + k] for k, w in enumerate(known) if w not in first]), "the start of a text is a context"


def test_context_mixing_on_tiny_vocabularies(spark):
    r = random.Random(4)
    for texts in [["a"], ["w"] * 500, ["ab a", "abc"], [None], ["a b", "a b"], [" ".join(r.choice(["a", "b", "abcd"]) for _ in range(r.randint(0, 5))) for _ in range(30)]]:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = contextmix.score(docs, F.col("doc_id") == 0, chunk_tokens=7, shard_words=3, shard_tokens=5).collect()
        assert len(got) == len(texts) and all(np.isfinite(x["score"]) and x["score"] <= 0 for x in got)
        assert all((x["bits_per_byte"] is None) == (not texts[x["doc_id"]]) for x in got)


def test_context_mixing_does_not_depend_on_how_texts_are_dealt(spark):
    rows = [(k, words(k % 50, 40)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = is_fold(F.col("doc_id"), 7, 2)
    one = {r["doc_id"]: r["score"] for r in contextmix.score(docs.repartition(3), held, chunk_tokens=900).collect()}
    two = {r["doc_id"]: r["score"] for r in contextmix.score(docs.repartition(5), held, chunk_tokens=2_000).collect()}
    assert one == pytest.approx(two, rel=1e-4)


def brute_cut(content, boilerplate, edges):
    n, best = len(content), None
    for mask in range(1 << n):
        inside = [mask >> k & 1 for k in range(n)]
        cost = sum(boilerplate[k] if inside[k] else content[k] for k in range(n)) + sum(w for a, b, w in edges if inside[a] != inside[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_equals_brute_force():
    r = random.Random(5)
    for _ in range(150):
        n = r.randint(1, 7)
        content, boilerplate = [np.array([r.random() * 3 for _ in range(n)]) for _ in range(2)]
        edges = [(a, b, r.random()) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        kept = mainhtml.min_cut(content, boilerplate, edges)
        cost = sum(boilerplate[k] if kept[k] else content[k] for k in range(n)) + sum(w for a, b, w in edges if kept[a] != kept[b])
        assert cost == pytest.approx(brute_cut(content, boilerplate, edges))


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
      <div class="cookie-notice">We use cookies.</div><article><h1>A  title</h1><p><b>First &amp; best.<br><p>Second\n part &#233;.</p><div class="comments"><p>Nice one!</p></div></article><aside>Side</aside>
      <form><p>Subscribe now</p></form><footer>&copy; us</footer></body></html>"""
    assert mainhtml.extract(page) == "A title\nFirst & best.\nSecond part é."
    rows = [(1, "u", page), (2, None, None), (3, "w", ""), (3, "w", "<p>only <b>unclosed"), (None, "z", "</div>stray</p>text that goes on, and on.")]
    got = mainhtml.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert mainhtml.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hashed_sample(spark):
    df = spark.range(1000)
    assert hashed_sample(df, F.xxhash64("id"), 50).count() == 50 and hashed_sample(df.limit(0), F.xxhash64("id"), 5).count() == 0


def labelled_page(k, wrapper="article", menu="nav"):
    r, text = random.Random(k), [words(k * 10 + j, 30) + "." for j in range(4)]
    links = "".join(f'<li><a href="/{j}">{words(k * 100 + j, 2)}</a></li>' for j in range(r.randint(3, 7)))
    return f'<html><body><{menu} class="top"><ul>{links}</ul></{menu}><{wrapper}><h1>{words(k, 5)}</h1>' + "".join(f"<p>{t}</p>" for t in text) + f"</{wrapper}><footer><p>&copy; {words(k + 1, 3)} | x</p></footer></body></html>", "\n".join([words(k, 5), *text])


def test_main_text_is_cut_where_no_element_names_it():
    """Pages without article or nav elements, where names and elements alone say nothing."""
    model = mainhtml.train([labelled_page(k)[0] for k in range(80)])
    pages = [labelled_page(k, "div", "div") for k in range(200, 230)]
    assert sum(mainhtml.extract(h, model) == t for h, t in pages) >= 28
    assert all(mainhtml.extract(h, model) == t for h, t in map(labelled_page, range(300, 320)))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="post type-post format-standard hentry"><h1>T</h1><p>Long text goes on here, with many words.</p></div>', "T\nLong text goes on here, with many words."),
        ("<article><p title=don't>One text, long.</p><p>It's two.</p></article>", "One text, long.\nIt's two."),
        ('<article><p><img alt=5">Text a.</p><svg><p>After it, some text.</p></article>', "Text a.\nAfter it, some text."),
        ("<article><p>x is <math><mi>y</mi></math>, right.</p><noscript><p>No script here.</p></noscript></article>", "x is y, right.\nNo script here."),
        ('<div class="layout has-sidebar"><article><p>The main text, full of words.</p></article></div>', "The main text, full of words."),
        ('<article><p>Before.</p><p style="display:none">Hidden.</p><p>After &lt;b&gt;.</p></article>', "Before.\nAfter <b>."),
    ],
)
def test_main_text_of_odd_markup(page, text):
    assert mainhtml.extract(page) == text
