import random
import re

import pytest

from cohortlens.llm import lines as L

SCHEMA = "doc_id bigint, text string, dk string"


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute(rows, similarity=0.8):
    """Places that go, by all pairs of lines."""
    places = sorted({((d is not None, d or 0), p, line.strip(" ").lower()) for d, t, *_ in rows if t for p, line in enumerate(t.split("\n")) if line.strip(" ")})
    texts = sorted({t for _, _, t in places})
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= similarity * (len(sets[i]) + len(sets[j]) - same) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    at, seen, out = {t: i for i, t in enumerate(texts)}, set(), {}
    for d, p, t in places:
        r = root(at[t])
        if r in seen:
            out.setdefault(d[1] if d[0] else None, []).append(p)
        seen.add(r)
    return out


def family(rng, n):
    words = ["alpha", "river", "stone", "paper", "light", "garden", "window", "letter", "morning", "quiet", "table", "number"]
    base = [[rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(30)] for _ in range(5)]
    out = []
    for _ in range(n):
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
            line[rng.randrange(30)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(line))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = family(rng, 120) + ["short line", ""] + [" ".join(f"u{rng.randrange(10**9)}" for _ in range(20)) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))), "z") for i in range(90)]
    got = {r.doc_id: list(r.dropped) for r in L.dropped_lines(spark.createDataFrame(rows, SCHEMA)).collect() if r.dropped}
    want = brute(rows)
    missed = sum(len(set(want[d]) - set(got.get(d, []))) for d in want)
    assert not any(set(got[d]) - set(want.get(d, [])) for d in got)
    assert missed <= 0.02 * sum(map(len, want.values()))


def test_rows_and_edges(spark):
    line = "this line of text is long enough to be told from others by its words"
    wide = "".join(f"{i * 7919 % 9973:04d}" for i in range(1500))
    rows = [
        (2, f"{line}\nshort\nshort", "a"), (5, f"own words stand at the start of this document here\n  {line.upper()}  \nend", "b"), (7, None, "c"), (8, "", "d"), (2, f"{line}\nshort\nshort", "a"),
        (None, f"{line} indeed", "n"), (9, wide, "e"), (10, wide + "c", "f"), (11, f"{line}", "g"), (12, f"{line}\n" * 3000, "h"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = L.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    want = [
        (2, "short", 3, 2), (2, "short", 3, 2), (5, "own words stand at the start of this document here\nend", 3, 1), (7, None, 0, 0), (8, "", 1, 0),
        (None, f"{line} indeed", 1, 0), (9, wide, 1, 0), (10, "", 1, 1), (11, "", 1, 1), (12, "", 3001, 3000),
    ]
    assert got == sorted(want, key=str)
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_other_shape_of_ids(spark):
    docs = spark.createDataFrame([("b", "x y z " * 12), ("a", "x y z " * 12)], "doc_id string, text string")
    assert {r.doc_id: r.n_dropped for r in L.dedup_lines(docs).collect()} == {"a": 0, "b": 1}


def test_no_python_in_the_plan(spark):
    out = L.dropped_lines(spark.createDataFrame([(1, "x" * 50, "k")], SCHEMA))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def character_brute(lines, similarity=0.8, window=8):
    """Which lines (all of one place) go, by all pairs of sets of character windows."""
    sets, root = [{t[i : i + window] for i in range(max(1, len(t) - window + 1))} for t in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if root[i] != root[j] and same >= similarity * (len(sets[i]) + len(sets[j]) - same) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if r != i}


def test_typing_errors_and_short_copies(spark):
    base = "the river went slowly past all of the old gardens while nobody there looked at it"
    lines = [base, base.replace("slowly", "slawly"), base.replace("nobody", "nobidy"), "Subscribe to our newsletter today", "own line", "Subscribe to our newsletter today", "ok", "OK "]
    got = {r.doc_id for r in L.dropped_lines(spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)], SCHEMA)).collect() if r.dropped}
    assert got == {1, 2, 5, 7}


def test_lines_of_few_shingles(spark):
    lines = ["aaaaaaaaa", "aaaaaaaaaa", "a" * 40, "abababababababa", "abababab" * 4, "abcdefgh", "abcdefghi", "abc", "abcd", "中文" * 3, "中文" * 4, "🙂" * 5, "🙂" * 9]
    got = {r.doc_id for r in L.dropped_lines(spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)], SCHEMA)).collect() if r.dropped}
    assert got == {1, 2, 4, 12}


def test_recall_of_pairs_at_the_threshold(spark):
    """Each pair stands alone, so nothing but its own link can drop its second line; letters of several widths in UTF-8."""
    rng = random.Random(11)
    pairs = []
    for k in range(400):
        letters = ("abcdefghijklmnopqrstuvwxyz ", "abcdeéèüößñ ", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341\u767e\u5343")[k % 3]
        one = "".join(rng.choice(letters) for _ in range(rng.randrange(60, 400))).strip()
        two = list(one)
        for _ in range(rng.randrange(1, 5)):
            two[rng.randrange(len(two))] = rng.choice("XYZ")
        two = "".join(two)
        a, b = shingles(one.lower()), shingles(two.strip().lower())
        if 0.8 <= len(a & b) / len(a | b) < 1:
            pairs.append((one, two))
    rows = [(2 * i + j, t, "z") for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.doc_id for r in L.dropped_lines(spark.createDataFrame(rows, SCHEMA)).collect() if r.dropped}
    want = {2 * i + 1 for i in range(len(pairs))}
    assert len(pairs) > 150 and not got - want
    assert len(got) >= 0.95 * len(want)


def test_character_shingles_of_short_prose(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(rng.randrange(8, 18))]
        base = " ".join(words)
        at = rng.randrange(len(base))
        lines += [base, base[:at] + "#" + base[at + 1 :], f"{base[: len(base) // 2]} {rng.randrange(10**6)} {base[len(base) // 2 :]}", base + "!"]
    want = character_brute(lines)
    got = {r.doc_id for r in L.dropped_lines(spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)], SCHEMA)).collect() if r.dropped}
    assert len(want) > 80 and not got - want
    assert len(want - got) <= 0.02 * len(want)


def test_families_in_a_large_band(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = "all of these lines begin with the same long words of a template that fills bands " + "and goes on for some while so that most of its windows are in every line of it "
    lines = [f"{base}{rng.randrange(10)}" for base in (head + word(24) for _ in range(300)) for _ in range(4)]
    rng.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    want = character_brute(lines)
    got = {r.doc_id for r in L.dropped_lines(spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)], SCHEMA)).collect() if r.dropped}
    assert len(lines) > 1000 and len(want) > 600 and not got - want
    assert len(want - got) <= 0.01 * len(want)


def test_every_pair_of_a_large_band(spark):
    """300 pairs at 0.82 whose lines are at 0.78 to all others: of the pairs that share a band none may be lost, in whatever blocks."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = word(300)
    pairs = [tuple(head + own + word(34) for _ in range(2)) for own in {x[:4]: x for x in (word(8) for _ in range(300))}.values()]
    rows = [(i, t, "z") for i, t in enumerate(rng.sample([t for p in pairs for t in p], 2 * len(pairs)))]
    docs, at = spark.createDataFrame(rows, SCHEMA), {t: i for i, t, _ in rows}
    hashes = {r.t: r.line for r in L._lines(docs, "text").select("t", "line").collect()}
    keys = {r.line: set(r["keys"]) for r in L.line_keys(docs, "text").collect()}
    shared = [p for p in pairs if keys[hashes[p[0]]] & keys[hashes[p[1]]]]
    sizes = {}
    for k in (k for x in keys.values() for k in x):
        sizes[k] = sizes.get(k, 0) + 1
    assert len(shared) >= 290 and max(sizes.values()) > 100
    want = {max(at[a], at[b]) for a, b in shared}
    for options in ({}, {"block": 50}):
        got = {r.doc_id for r in L.dropped_lines(docs, **options).collect() if r.dropped}
        assert got == want


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    lines = [base[: rng.randrange(20, 700)].replace(rng.choice("abc"), rng.choice("xyz"), rng.randrange(4)) for _ in range(40)] + ["ab" * 300, "short"]
    texts = spark.createDataFrame([(i, t, len(shingles(t))) for i, t in enumerate(lines)], "line bigint, t string, n int")
    bits = {r.line: [r[f"s{i}"] for i in range(L.SKETCH)] for r in L.sketches(texts).collect()}
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
    own = [len(shingles(t)) for t in lines]
    assert all(sum((x & (2**64 - 1)).bit_count() for x in bits[i]) <= own[i] for i in bits)
    assert all(differ(a, b) <= len(shingles(lines[a]) ^ shingles(lines[b])) for a in bits for b in bits)
    assert all(differ(a, b) > 0 for a in bits for b in bits if shingles(lines[a]) != shingles(lines[b]) and len(shingles(lines[a]) ^ shingles(lines[b])) % 2)


def test_folded_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    lines = [base[: rng.randrange(20, 900)].replace(rng.choice("abc"), rng.choice("xyz"), rng.randrange(6)) for _ in range(30)] + ["ab" * 300, "short"]
    rows = L.sketched_words(spark.createDataFrame([(i, t, len(shingles(t))) for i, t in enumerate(lines)], "line bigint, t string, n int")).collect()
    folded = {r.line: [r[f"f{j}"] for j in range(L.FOLDED)] for r in rows}
    assert len(rows) == len(lines) and all(len(r.words) == L.SKETCH for r in rows)
    for r in rows:
        whole = [0] * L.FOLDED
        for i, w in enumerate(r.words):
            whole[i % L.FOLDED] ^= w
        assert whole == folded[r.line]
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(folded[a], folded[b], strict=True))
    assert all(differ(a, b) <= len(shingles(lines[a]) ^ shingles(lines[b])) for a in folded for b in folded)


def test_no_step_makes_a_column_of_each_word(spark, monkeypatch):
    """An aggregate over 48 columns was compiled to a method of 340 kB, in memory that no heap bounds."""
    plans, write = {}, L.written

    def seen(df, name, *args, **options):
        plans[name] = len(df.columns), df._jdf.queryExecution().optimizedPlan().toString().count("bit_count")
        return write(df, name, *args, **options)

    monkeypatch.setattr(L, "written", seen)
    rng = random.Random(3)
    head = "".join(rng.choice("abcdefghijklmnop") for _ in range(200))
    lines = [head + "".join(rng.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(12)]
    L.dropped_lines(spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)], SCHEMA)).collect()
    assert "line-sketches" in plans and all(columns <= 20 and counts <= 20 for columns, counts in plans.values()), plans


def test_all_lines_are_lowered_once_and_not_sorted(spark, monkeypatch):
    """lower() was computed again in each condition of a filter, and the keys of all lines were sorted to meet few bands."""
    plans, write = {}, L.written

    def seen(df, name, *args, **options):
        plans.setdefault(name, df._jdf.queryExecution())
        return write(df, name, *args, **options)

    monkeypatch.setattr(L, "written", seen)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(["", "Too", "Short", *family(rng, 30)])], SCHEMA)
    L.dropped_lines(docs).collect()
    assert {name: plans[name].optimizedPlan().toString().count("lower(") for name in ("line-places", "line-signatures", "line-texts")} == {"line-places": 1, "line-signatures": 1, "line-texts": 1}
    joins = {name: re.findall(r"(?<=  )Join \w+.*|(?<=- )Join \w+.*", plans[name].optimizedPlan().toString()) for name in ("line-band-members", "line-found")}
    assert all(len(found) == 1 and "shuffle_hash" in found[0] for found in joins.values()), joins


def test_lines_that_are_blank_or_shorter_than_a_window(spark):
    docs = spark.createDataFrame([(1, " \n\nabcdefg\n  ABCDEFGH \nxabcdefghi", "z"), (2, "", "z"), (3, None, "z")], SCHEMA)
    lines = {r.t: r.line for r in L._lines(docs, "text").collect()}
    assert set(lines) == {"abcdefg", "abcdefgh", "xabcdefghi"}
    assert {r.line for r in L.line_keys(docs, "text").collect()} == {lines["abcdefgh"], lines["xabcdefghi"]}
