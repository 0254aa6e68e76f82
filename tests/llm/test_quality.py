import random
import re

import pytest

from cohortlens.llm import quality as Q


def brute(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    spots, seen = set(), {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            spots |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(spots)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n x\nx", "é#* b c |<>", "\U0001f600 b c \U0001f600 b c"]
    return out + ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "#"]) for _ in range(rng.randrange(400))) for _ in range(60)] + ["w1 w2 w3 w4\n" * 9000]


def test_measurements(spark):
    rows = [(i, t, 9) for i, t in enumerate(texts())] + [(3, "a", 9), (None, "a b c", 9)]
    book = Q.ledger(spark.createDataFrame(rows, "doc_id bigint, text string, n_words int"))
    got = sorted(((r.doc_id, r.text), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in book.fillna({"doc_id": -1, "text": ""}).collect())
    want = sorted(((-1 if i is None else i, t or ""), brute(t)) for i, t, _ in rows)
    assert got == want


def test_policies_and_ablations(spark):
    rows = [(1, "word " * 60), (2, "few"), (3, "a b c " * 40), (4, " ".join(f"good{i}" for i in range(80)))]
    book = Q.ledger(spark.createDataFrame(rows, "doc_id bigint, text string")).cache()
    keeps = {v: {r.doc_id for r in book.where(Q.kept(v)).collect()} for v in Q.POLICIES}
    assert keeps == {"base-1": {4}, "web-1": {4}, "strict-1": {4}}
    found = {r.rule: (r.n_failed, r.n_only) for r in Q.ablations(book, "base-1").collect()}
    assert found == {"few_words": (1, 1), "repeated_windows": (2, 2)}
    assert Q.ablations(book.limit(0), "web-1").collect()[0].n_failed == 0


def test_no_python_in_the_plan(spark):
    book = Q.ledger(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
    plan = book._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("rule", Q.RULES)
def test_bits_are_their_own(rule):
    assert sum(r.bit == rule.bit for r in Q.RULES) == 1
