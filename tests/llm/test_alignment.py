"""Aligned tokens and corpus-wide counts against a token-by-token version, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import alignment

tokenizers_ = pytest.importorskip("public_tokenizers")
A, B = tokenizers_.path("byte_bpe_50k.json"), tokenizers_.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, chunk string, pair string, n long, n_a string"


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(A, B)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


TEXTS = [
    None, "", " ", "a", "Hello world, hello  WORLD!", "日本語のテキスト 👍🏽 ñandú", "tab\tnew\nline\r\n  end ", "<|endoftext|> <s> </s> <unk> <0x41> <|", "▁ a literal mark", "ends▁", "nul\0inside", "é ﬁ ％",
    "x" * 3000, "the cat the cat the cat", " leading", "1234567 89,0.1", " nbsp　wide", "﻿bom",
]


def spans(pieces):
    at = 0
    for k in pieces:
        yield at, at + len(k)
        at += len(k)


def brute(first, second, text):
    """(ids of A, ids of B, groups, links as pairs of ids) of one text, token by token."""
    if not text:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    left = [bytes(letters[c] for c in first.id_to_token(k)) for k in a]
    right = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and second.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [second.id_to_piece(k)]]
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return None
    sa, sb = list(spans(left)), list(spans(right))
    ends = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, at = [], 0
    for e in ends:
        groups.append(([k for k, s in zip(a, sa, strict=True) if at < s[1] <= e], [k for k, s in zip(b, sb, strict=True) if at < s[1] <= e]))
        at = e
    links = [(x, y) for x, s in zip(a, sa, strict=True) for y, t in zip(b, sb, strict=True) if s[0] < t[1] and t[0] < s[1]]
    return a, b, groups, links


def brute_rows(texts, library):
    found = [brute(*library, t) for t in texts]
    count = Counter(p for f in found if f for p in set(f[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = f
            written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            yield len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(written.encode()).hexdigest()


def invented(seed, n):
    r = random.Random(seed)
    alphabet = "abcdefghijk ABC,.'  \n0123äßñ語👍-"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("links", [alignment.CHUNK_LINKS, 40])
def test_rows_equal_brute_force_whatever_the_chunks(spark, library, links):
    texts = TEXTS + TEXTS[3:7] + invented(3, 120)
    rows = [(None if k == 4 else k % 100, t, "x", "y", 1, "z") for k, t in enumerate(texts)]
    got = alignment.aligned(spark.createDataFrame(rows, DOCS).repartition(5), A, B, links, 7 if links == 40 else 4096).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute_rows(texts, library), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert alignment.aligned(spark.createDataFrame(rows, DOCS).limit(0), A, B).count() == 0


def test_slices_change_nothing(both):
    text = " ".join(invented(5, 300))
    whole = alignment.Aligned(both, text)
    for step in (1, 7, 1000):
        cut = alignment.Aligned(both, text, step)
        assert (cut.n_a, cut.n_b, cut.n_groups, cut.n_links, cut.sha) == (whole.n_a, whole.n_b, whole.n_groups, whole.n_links, whole.sha)
        assert np.array_equal(cut.pairs, whole.pairs) and np.array_equal(cut.times, whole.times)


def test_long_runs_of_white_space_and_special_strings_are_plain(both, library):
    for text in ("a" + " " * 60_000 + "b<|endoftext|>", "<|endoftext|>" * 3):
        assert both.encode(text)[0].tolist() == library[0].encode(" " + text, add_special_tokens=False).ids
