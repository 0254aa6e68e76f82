import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAPH = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """(cost, audit) of [(initial, fault)]: the least (cost, audit) first from every (row, state), as audits only grow."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        ways = [(5, "I", i, GRAPH.get((state, x))) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            ways.append((2, "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways.append((more, "K", i + 1, GRAPH.get((state, initial))))
                ways += [(1 + more, "R", i + 1, GRAPH.get((state, x))) for x in "ua"]
        for c, letter, j, to in ways:
            if to is not None:
                heapq.heappush(heap, (cost + c, audit + letter, j, to))


def brute(rows):
    """{conv_id: what op13 gives} of (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role = "user" if kind == 4 else role
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain([(r[1][:1], f) for r, f in zip(own, faults, strict=True)])
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        size = sum(x != "D" for x in audit)
        due = (["system"] if size % 2 else []) + ["user", "assistant"] * size
        left, made = iter(own), []
        for letter in audit:
            r = None if letter == "I" else next(left)
            if letter != "D":
                role = r[1] if letter == "K" else due[len(made)]
                made.append((role, "" if r is None else r[2]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(":".join(x) for x in made).encode()).hexdigest())
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13(spark, str(tmp_path))
    assert got.columns == ["conv_id", *C.STATS, "audit", "repaired_sha256"]
    got = got.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def corpus(seed, convs):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "A longer answer!", "cut", "Ends here?\n ", "", " \t", None, f"Own {rng.random()}."])
    return [(i, t if rng.random() > 0.05 else None, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), text()) for i in range(convs) for t in rng.sample(range(12), rng.randrange(1, 9))]


def symbols(rows):
    return "".join(chr(97 + 3 * "sua".find(i) % 12 + {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}[f]) if i in "sua" else chr(106 + {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}[f]) for i, f in rows)


@pytest.mark.parametrize("seed", range(30))
def test_matrices_and_rules_agree_with_a_plain_search(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suaut"), rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randrange(12))]
    want = plain(rows)
    text, rules = symbols(rows), []
    for i in range(rng.randrange(8)):
        now = text
        for symbol, pair in rules:
            now = now.replace(pair, symbol)
        if len(now) > 1:
            at = rng.randrange(len(now) - 1)
            rules.append((chr(0x100 + i), now[at : at + 2]))
    whole = C.product(C.Grammar(rules).of(text), C.insertions())
    best = C.better(whole[0][0], whole[0][3])
    assert (best[0], C.flat(best[1])) == want


def test_every_short_sequence():
    kinds = [(i, f) for i in "suat" for f in ("", "blank", "truncated")]
    grammar = C.Grammar([])
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            whole = C.product(grammar.of(symbols(rows)), C.insertions())
            best = C.better(whole[0][0], whole[0][3])
            assert (best[0], C.flat(best[1])) == plain(rows)


def test_against_brute_force(spark, tmp_path):
    rows = corpus(3, 150)
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (900, None, "user", "A."), (900, None, "assistant", "B.")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_one_conversation_holds_a_third_and_is_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["A.", "B.", "cut", f"Text {i}."])) for i in range(200)] + corpus(5, 60)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_dropped_conversations_and_empty_table(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = run(spark, tmp_path / "one", [(gone, 0, "user", "Gone.")])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, tmp_path / "none", []) == {}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "assistant", "Bye."), (2, 0, "system", "Be."), (3, 0, "assistant", "x" * 100_000 + ".")]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("other"))
    ordered, verdicts = C.analyse(turns)
    assert {r.conv: (r.cost, r.audit) for r in verdicts.collect()} == {1: (2, "DKK"), 2: (2, "D"), 3: (2, "D")}
    assert sorted(map(tuple, C.repaired(ordered, verdicts).collect())) == [(1, 0, "user", "Well."), (1, 1, "assistant", "Bye.")]
    renamed = turns.select(F.col("conv_id").alias("a.b"), "turn", "role", "text")
    assert {r.conv for r in C.analyse(renamed, conv_col="a.b")[1].collect()} == {1, 2, 3}
