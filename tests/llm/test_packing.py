import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bandweave.llm import packing as P

public = pytest.importorskip("public_tokenizers")


def tokenizer():
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_ranks_give_the_tokenizers_ids():
    texts = ["a\n\n b  c\t\td", "   ", "日本語 𝔘x", "<|endoftext|> x", "é" * 3000, "a\x00b\r\n", "it's 12,345 They'LL", " x y", ""]
    encode = P.default_encoder()
    assert all([*encode(t), 0] == ids(t) for t in texts)


def test_cut():
    assert P.cut(5, 5) == [(0, 5)] and P.cut(6, 5) == [(0, 1), (1, 5)] and P.cut(15, 5) == [(0, 5), (5, 5), (10, 5)] and P.cut(1, 5) == [(0, 1)]


def check(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_every_piece_of_every_document(documents):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 1, 5, 30, 200, 900])))) for i in range(120)]
    got = P.pack_documents(documents(rows), capacity=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        want, pieces = np.array(ids(text), "<u4"), sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, s, n) for k, (s, n) in enumerate(P.cut(len(want), 256))]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in pieces]
    assert check(got, 256) <= plain_best_fit([r.length for r in got], 256)


def plain_best_fit(lengths, capacity):
    """Best fit, the longest first, piece by piece."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def plain_brackets(opens):
    stack, pairs, left = [], [], []
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        elif stack:
            pairs.append((stack.pop(), i))
        else:
            left.append(i)
    return sorted(pairs), left, stack


def test_brackets_and_crossings_match_as_one_stack_does():
    rng = random.Random(6)
    for _ in range(200):
        share, parts = rng.random(), rng.randrange(1, 7)
        opens = [rng.random() < share for _ in range(rng.randrange(1, 80))]
        cuts = sorted(rng.randrange(len(opens) + 1) for _ in range(parts - 1))
        pairs, counts, left = [], [], {}
        for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(opens)], strict=True)):
            place, piece, no_place, no_piece = (x + lo for x in P.brackets(np.array(opens[lo:hi], bool)))
            pairs += zip(place.tolist(), piece.tolist(), strict=True)
            counts.append((part, len(no_place), len(no_piece)))
            left[part] = (no_place, no_piece)
        for part, first, n, of, place in P.crossings(counts):
            pairs += [(int(left[of][1][place - i]), int(left[part][0][first + i])) for i in range(n)]
        assert sorted(pairs) == plain_brackets(opens)[0]


def packed(spark, lengths, capacity, range_rows):
    rows = [(i // 3, 0, 0, n, 7) for i, n in enumerate(lengths)]  # rows that repeat as well
    return P.pack(spark.createDataFrame(rows, P.PIECES), capacity, range_rows).collect()


@pytest.mark.parametrize("seed", [2])
def test_sweeps_use_as_few_sequences_as_piecewise_best_fit(spark, seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randrange(100, 400))]
    whole, ranged = packed(spark, lengths, capacity, 10_000), packed(spark, lengths, capacity, 40)
    assert sorted(r.length for r in whole) == sorted(lengths)
    assert check(whole, capacity) <= plain_best_fit(lengths, capacity)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, ranged))  # one result, however many ranges


def test_a_hot_length(spark):
    lengths = [30] * 300 + [10] * 40
    got = packed(spark, lengths, 100, 50)
    assert check(got, 100) == 100 and len(got) == 340


def test_odd_rows(odd_documents):
    got = P.pack_documents(odd_documents).collect()
    check(got, 2048)
    assert sorted((r.doc_id, r.length) for r in got if r.doc_id in (0, 9)) == [(0, 1), (9, 1)]
    assert len([r for r in got if r.doc_id == 3]) == 2 and len([r for r in got if r.doc_id == 8]) > 10
    assert P.pack_documents(odd_documents.limit(0)).count() == 0


def test_ids_of_the_unaltered_tokenizer(documents):
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n x", "  <|endoftext|>  ", "<|endoftext|", "it's <|endoftext|>é's", " " * 120_000 + "<|endoftext|> x", "a b", ""]
    encode = P.contract_encoder()
    assert [list(encode(t)) for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(texts[0]) == [64, 220, 50256, 275]
    got = P.pack_documents(documents([(1, texts[0])])).first()
    assert (got.length, got.ids_crc32) == (5, zlib.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes()))
