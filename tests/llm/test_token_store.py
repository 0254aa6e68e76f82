import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import token_store as T
from cohortlens.llm.encoding import SegmentEncoder, vocabulary

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ENC = {f: SegmentEncoder(vocabulary(f), lead, max_segments=50) for f, lead in FILES.items()}


def plain(f, text):
    return ENC[f].tokenizer.encode(text, add_special_tokens=False).ids


def encode(f, texts):
    ids, at = ENC[f].encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  \x1c\x85aB1é'́ſΣ"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_segments_are_exact(texts):
    for f in FILES:
        for text, got in zip(texts, encode(f, texts), strict=True):
            assert got == plain(f, text)


def test_special_strings_and_long_words():
    for text in ("<|endoftext|> a <|endoftext|>", "x" * 9000 + " " + "ab" * 5000, "it's  the\n \n end  ", "  a", "ÀÉÎ ÇA VA, ICI! STRASSE ß İI ΑΣ Σ A\u030a", "THE Cat; thE"):
        for f in FILES:
            assert encode(f, [text]) == [plain(f, text)]


@pytest.mark.parametrize("values,u", [([], 0), ([0], 0), ([5], 5), ([0, 0, 0], 0), ([1, 1, 2, 900_000], 900_000), (list(range(2000)), 1999)])
def test_elias_fano(values, u):
    ef = T.EliasFano.of(np.array(values, dtype=np.int64), u)
    back, used = T.EliasFano.read(memoryview(ef.tobytes() + b"xyz"), len(values), u, ef.low_bits)
    assert used == len(ef.tobytes())
    assert back.values().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small_and_random_access():
    rng = random.Random(3)
    values = np.sort(np.array([rng.randrange(50_000_000) for _ in range(20_000)]))
    ef = T.EliasFano.of(values, 50_000_000)
    assert len(ef.tobytes()) < 20_000 * 8 / 4
    assert all(ef.select(i) == values[i] for i in range(0, 20_000, 371))
    with pytest.raises(IndexError):
        ef.select(20_000)


def test_shard_round_trip_and_damage():
    data = T.pack_shard([None, -5, -5, 9], np.array([1, 1, 3, 4]), b"\1\0\2\0\3\0\4\0", 2)
    s = T.Shard(data)
    assert s.doc_ids() == [None, -5, -5, 9] == [s.doc_id(i) for i in range(4)]
    assert [s.ids(i).tolist() for i in range(4)] == [[1], [], [2, 3], [4]]
    for bad in (b"x" + data[1:], data[:-1]):
        with pytest.raises(ValueError):
            T.Shard(bad)


def test_files(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 40, " ".join(rng.choice(["the", "Idea", "été", "x\n", " "]) for _ in range(rng.randrange(60))), "z") for i in range(200)]
    rows += [(None, "null id", "a"), (5, None, "b"), (500, "twice", "c"), (500, "twice", "c")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    listing = T.write_tokens(docs, vocabulary("byte_bpe_50k.json"), block_tokens=300, partitions=3)
    got = sorted(T.read_tokens(listing).collect(), key=lambda r: r.start)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    at = 0
    for r, (doc_id, text, _) in zip(got, want, strict=True):
        ids = plain("byte_bpe_50k.json", text or "") + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert T.read_tokens(T.write_tokens(docs.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_any_span_of_ids():
    for ids in ([-(2**63), 2**63 - 1], [-(2**63), -5, 0, 2**62, 2**63 - 1], [2**63 - 1]):
        s = T.Shard(T.pack_shard(ids, np.arange(1, len(ids) + 1), b"\1\0" * len(ids), 2))
        assert s.doc_ids() == ids == [s.doc_id(i) for i in range(len(ids))]


def test_batches_by_bytes():
    from cohortlens.llm.encoding import by_bytes

    texts = ["x" * n for n in (0, 5, 300, 1, 0, 90, 40, 40, 40)] + [None]
    batches = pa.table({"t": texts}).to_batches(4)
    got = list(by_bytes(iter(batches), 0, 100))
    assert [x for b in got for x in b.column(0).to_pylist()] == texts
    assert all(sum(len(x or "") for x in b.column(0).to_pylist()) <= 200 + 300 for b in got) and len(got) > 2
    assert list(by_bytes(iter([]), 0)) == []
