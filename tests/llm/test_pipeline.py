import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as CP
from cohortlens.llm.encoding import SegmentEncoder, vocabulary
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import brute as brute_bins
from tests.llm.test_simhash import brute_components, brute_fingerprint

EN = ["the", "river", "went", "through", "quiet", "morning", "gardens", "while", "people", "there", "walked", "along", "paper", "windows", "with", "thoughts"]
DE = ["der", "fluss", "ging", "durch", "ruhige", "morgen", "während", "menschen", "dort", "spazierten", "entlang", "fenster", "mit", "gedanken", "zwischen", "häusern"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(9)
    line = lambda words: " ".join(rng.choice(words) + rng.choice(["", "s", "en", "x"]) for _ in range(12))
    rows = []
    for i in range(80):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append((i, "\n".join(line(words) for _ in range(rng.randrange(2, 7))), lang, rng.choice(["a", "a", "a", "b", None])))
    common = line(EN)
    rows += [(100 + i, f"{line(EN)}\n{common}\n{line(EN)}", "en", "b") for i in range(6)]
    rows += [(200 + i, rows[3][1], "en", "a") for i in range(4)]
    rows += [(300, None, "en", "a"), (301, "", "de", "a"), (302, "123 456 !!", None, "b"), (303, "the river", None, "b"), (3, rows[3][1], "en", "a"), (None, line(DE), None, "c")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in CP.STAGES] == ["language", "line_dedup", "simhash_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in CP.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]

    lang = seen["language"]
    assert Counter(lang) == Counter(r for r in rows if r[0] not in (300, 301, 302))

    gone = brute_lines([r[:2] for r in lang])
    want = Counter()
    for d, t, language, source, n in lang:
        drop = set(gone.get(d, []))
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
        if not drop or text.strip():
            want[(d, text, language, source, len(text) if drop else n)] += 1
    assert Counter(seen["line_dedup"]) == want

    kept = seen["line_dedup"]
    parts = brute_components([brute_fingerprint(r[1], 5) for r in kept], 6)
    groups = {}
    for r, p in zip(kept, parts, strict=True):
        groups.setdefault(p, []).append(r)
    least = lambda g: min((r[0] for r in g if r[0] is not None), default=None)
    assert Counter(r[0] for r in seen["simhash_dedup"]) == Counter(least(g) for g in groups.values())
    assert set(seen["simhash_dedup"]) <= set(kept)

    source = seen["simhash_dedup"]
    size = {r: len(r[1].split()) for r in source}
    totals, taken = Counter(), Counter()
    for r in source:
        totals[r[3]] += size[r]
    for r, n in Counter(seen["mixing"]).items():
        assert r in size and n <= 3
        taken[r[3]] += n * size[r]
    for s, target in brute_targets(dict(totals)).items():
        assert abs(taken[s] - target) <= 20

    enc = SegmentEncoder(vocabulary("word_bpe_49k.json"), False)
    lengths = []
    for r in seen["mixing"]:
        n = len(enc.tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
        lengths += [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0)
    pieces = docs.collect()
    assert Counter(r.length for r in pieces) == Counter(lengths)
    bins = Counter()
    for r in pieces:
        bins[r.sequence_id] += r.length
    assert sorted(2048 - n for n in bins.values()) == brute_bins(lengths, 2048)


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus()[:30], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert CP.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert CP.run(spark, f"{tmp_path}/none").count() == 0


def test_remains_of_copies_go(spark):
    long = "a line of more than forty characters that two documents of these have"
    rows = [(1, f"Heading\n{long}"), (2, f"Heading\n{long}"), (3, f"My own\n{long}"), (4, f"heading \n\n{long}\nHeading"), (5, "Heading")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in CP.lines(spark, docs, "").collect()}
    assert got == {1: f"Heading\n{long}", 3: "My own"}


NAMES = ["lang_pred", "score", "target", "size", "n", "s", "c", "h", "k", "t", "copies", "mix_source", "source_size", "copy", "line", "line2", "pos", "dk", "id", "drop", "band", "fp", "key", "component", "none", "first_id", "n_lines", "n_dropped", "piece", "start", "length", "ids", "part", "nth", "base", "rank", "offset", "rounds", "upto", "due", "extra", "before", "reached", "cell", "ps", "pn", "cs", "cn", "cc", "ck", "bs", "bn", "source_", "placed", "m", "first", "last", "fdk", "fpos", "label", "u", "v", "a", "b", "kept", "row", "text_", "level", "ratio", "cap", "w", "final", "open", "total", "all_w", "a.b", "a`b", "with space", "ü"]


def test_further_columns_pass_whole(spark, tmp_path):
    """A column of every name that stages use inside comes through with its row, and changes no result."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/plain")
    plain = spark.read.parquet(f"{tmp_path}/plain")
    wide = plain.select("*", *[F.concat_ws("|", F.lit(n), "doc_id").alias(n) for n in NAMES])
    for name, stage in CP.STAGES:
        wide, plain = stage(spark, wide, ""), stage(spark, plain, "")
        if name == "packing":
            assert sorted(wide.columns) == sorted(plain.columns) and wide.count() == plain.count()
            break
        wide.write.parquet(f"{tmp_path}/{name}-wide")
        plain.write.parquet(f"{tmp_path}/{name}-plain")
        wide, plain = (spark.read.parquet(f"{tmp_path}/{name}-{x}") for x in ("wide", "plain"))
        rows = wide.collect()
        own = lambda r: tuple(r[c] for c in plain.columns)  # noqa: B023, E731
        assert Counter(map(own, rows)) == Counter(map(tuple, plain.collect()))
        assert all(r[n] == (n if r.doc_id is None else f"{n}|{r.doc_id}") for r in rows for n in NAMES)


def test_line_stage_loses_no_link_of_a_large_band(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = word(300)
    texts = [head + own + word(34) for own in {x[:4]: x for x in (word(8) for _ in range(300))}.values() for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    kept = {r.doc_id for r in CP.lines(spark, docs, "").collect()}
    assert kept >= set(range(0, len(texts), 2))
    assert len(kept) <= 1.02 * len(texts) / 2  # each second line of a pair goes, but those that share no band
