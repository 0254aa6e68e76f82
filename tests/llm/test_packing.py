import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import packing as P
from cohortlens.llm.encoding import SegmentEncoder, vocabulary

VOCAB = vocabulary("word_bpe_49k.json")


def brute(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 20, 50])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(120))]
    placed, bins = P.best_fit_plan(Counter(lengths), capacity)
    held = {}
    for n, _, pieces, first, many, offset in placed:
        for k in range(pieces):
            held.setdefault(first + k // many, []).append((offset + k % many * n, n))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    rooms = sorted(capacity - sum(n for _, n in p) for p in held.values())
    assert rooms == brute(lengths, capacity) and bins == len(held)
    assert Counter(n for p in held.values() for _, n in p) == Counter(lengths)


def test_plan_stays_small_and_checks_lengths():
    placed, _ = P.best_fit_plan({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(placed) < 3 * 2048 * 11
    with pytest.raises(ValueError):
        P.best_fit_plan({9: 1}, 8)


def test_tree():
    tree = P.CapacityTree(10)
    for c in (3, 7, 10):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in range(1, 11)] == [3, 3, 3, 7, 7, 7, 7, 10, 10, 10]
    tree.add(10, -1)
    assert tree.tightest(8) is None


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["word", "Other", "x.", "été"]) for _ in range(rng.choice([0, 3, 30, 90]))), "keep") for i in range(120)]
    rows += [(500, None, None), (7, rows[7][1], "again"), (None, "no id", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").repartition(3)
    packed = P.pack(docs, VOCAB, capacity=64, keep=["doc_id", "extra"])
    got = packed.collect()
    enc = SegmentEncoder(VOCAB, False)
    want = Counter()
    for doc_id, text, extra in rows:
        ids = np.array(enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 64):
            want[(doc_id, extra, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes()))] += 1
    assert Counter((r.doc_id, r.extra, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in bins.values()) == brute([r.length for r in got], 64)
    whole = {r.sequence_id: r for r in P.sequences(packed).collect()}
    assert whole.keys() == bins.keys() and all(len(r.ids) == 4 * sum(n for _, n in bins[s]) for s, r in whole.items())
    assert P.pack(docs.limit(0), VOCAB).count() == 0
