import random

import numpy as np
import pytest
import xxhash

from cohortlens.llm import simhash as S
from cohortlens.llm.components import connected_components


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "Ab", "a b", "É A\x0bB c d e f", "x y z " * 50])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def family(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    out = []
    for _ in range(n):
        x = rng.choice(seeds)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_kernel(seed, radius):
    fps = np.array(family(random.Random(seed), 300), dtype=np.uint64)
    keys = np.sort(np.array([random.Random(seed + i).randrange(5) for i in range(300)]))
    got = S.link_sorted(keys, fps, radius)
    for k in range(5):
        at = np.flatnonzero(keys == k)
        assert (got[at] - at[0]).tolist() == brute_components([int(x) for x in fps[at]], radius)


@pytest.mark.parametrize("hot,radius", [(3, 3), (40, 3), (1 << 15, 3), (20, 6), (1 << 15, 6)])
def test_all_links(spark, hot, radius):
    fps = sorted(set(family(random.Random(7), 500)))
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp bigint")
    labels = {r.id: r.component for r in connected_components(S.near_links(df, radius, hot)).collect()}
    want, signed = brute_components(fps, radius), [f - (f >> 63 << 64) for f in fps]
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, []).append(i)
    for members in groups.values():
        assert {labels.get(signed[i], signed[i]) for i in members} == {min(signed[i] for i in members)}


def test_components_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 5), (None, 3), (100, 101)], "a bigint, b bigint")
    got = {r.id: r.component for r in connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0


def test_rows_and_edges(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(1, text, "x"), (2, text + " tail", "x"), (7, "other words stand here", None), (4, None, "x"), (3, "", "y"), (7, "other words stand here", None), (None, "lonely text of its own", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (7, 7), (7, 7), (4, 3), (3, 3), (None, None)], key=str)
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 3, 7, None], key=str)
    assert S.simhash_components(docs.limit(0)).count() == 0


def test_ids_that_are_null_or_shared(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(200))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (9, text("c")), (5, text("d")), (5, text("e")), (1, text("e"))]
    got = [(r.doc_id, r.text[:1]) for r in S.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (None, "b"), (9, "c"), (5, "d"), (1, "e")], key=str)
