"""Structure repair of conversations by min-plus transfer matrices over a shared grammar.

A conversation is a sequence of symbols, a role's initial with a fault. Sequences are cut into chunks of at most
CHUNK rows; pairs of neighbouring symbols that are frequent in all chunks become symbols of their own, round by round
(Re-Pair; the pairs of a round have no symbol in common, so that they are replaced at once). Each rule has one matrix:
for every state of the role pattern before and after it, the least cost and the audit that has it, a rope of its parts'
audits. Matrices of rules are made from those of their parts, bottom-up and once; a chunk's is the product of the few
symbols that it is compressed to, a conversation's that of its chunks. Rules only save work: what no rule covers is
multiplied symbol by symbol, with the same result.

Audits of one cost are compared as text, and that is safe under products: of two audits of the same rows at the same
cost neither starts with the other, as what is longer has insertions more.

Rows are sorted as a table, not in groups; counts, first copies and chunks are partial sums of it. Only a conversation's
repaired text is one stream, as its digest is one: rows pass through a task in batches and nothing of them is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import small_batches, table, written
from cohortlens.llm.ranks import in_order

#: Rows of a chunk, at most; rules of a grammar, rounds in which they are found, and pairs that a round looks at.
CHUNK, RULES, ROUNDS, PAIRS = 4096, 1024, 14, 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Initials of roles by their place in a symbol; any other initial is the fourth.
INITIALS = "sua"
FULL = {"u": "user", "a": "assistant"}
BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
FINE, GONE, CUT = range(3)
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; and what an output leads to.
STATES = range(4)
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTED = (0, 3)

Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def flat(rope: Rope) -> str:
    """The text of a rope."""
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += (x[1], x[0])
        else:
            out.append(x)
    return "".join(out)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    """The entry of less cost, of those of one cost the one whose audit is least."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if flat(a[1]) <= flat(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k in STATES:
            if (x := a[i][k]) is None:
                continue
            for j in STATES:
                if (y := b[k][j]) is not None and ((best := out[i][j]) is None or x[0] + y[0] <= best[0]):
                    out[i][j] = better(best, (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]))
    return out


def product_of(parts: list[Matrix]) -> Matrix:
    """The product of matrices in order, by halves, so that ropes are no deeper than a logarithm."""
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else insertions()


def insertions() -> Matrix:
    """Any number of inserted rows, which costs least; none where nothing is asked for."""
    one: Matrix = [[None] * 4 for _ in STATES]
    for role in FULL:
        for i, j in STEP[role].items():
            one[i][j] = (INSERT, "I")
    out: Matrix = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    for _ in STATES:
        more = product(out, one)
        out = [[better(out[i][j], more[i][j]) for j in STATES] for i in STATES]
    return out


def row_matrix(symbol: str) -> Matrix:
    """Insertions, then what can be done with one row."""
    role, fault = divmod(ord(symbol) - 97, 3)
    own: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        own[i][i] = (DELETE, "D")
        if fault == GONE:
            continue
        extra = TRUNCATED if fault == CUT else 0
        ways = [(x, REROLE + extra, "R") for x in FULL] + ([(INITIALS[role], KEEP + extra, "K")] if role < len(INITIALS) else [])
        for x, cost, letter in ways:
            if (j := STEP[x].get(i)) is not None:
                own[i][j] = better(own[i][j], (cost, letter))
    return product(insertions(), own)


def learn(chunks: DataFrame) -> list[tuple[str, str]]:
    """Rules (new symbol, pair), earlier ones first, of (symbols, weight): pairs that occur twice or more, most frequent first.

    All chunks are counted in every round; only a round's most frequent pairs come to the driver.
    """
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        places = F.sequence(F.lit(1), F.length("symbols") - 1)
        pairs = chunks.where("length(symbols) > 1").select(F.explode(F.transform(places, lambda i: F.substring("symbols", i, F.lit(2)))).alias("pair"), "weight")
        top = pairs.groupBy("pair").agg(F.sum("weight").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "pair").limit(PAIRS).collect()
        new, used = [], set()
        for r in top:
            if not used & set(r.pair) and len(rules) + len(new) < RULES:
                new.append((chr(0x100 + len(rules) + len(new)), r.pair))
                used |= set(r.pair)
        if not new:
            break
        rules += new
        text = F.col("symbols")
        for symbol, pair in new:
            text = F.replace(text, F.lit(pair), F.lit(symbol))
        chunks = written(chunks.select(text.alias("symbols"), "weight").groupBy("symbols").agg(F.sum("weight").alias("weight")), "conversation-grammar")
    return rules


class Grammar:
    """Rules with their matrices, each made once of its parts'."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {chr(97 + i): row_matrix(chr(97 + i)) for i in range(12)}
        for symbol, (a, b) in rules:
            self.matrices[symbol] = product(self.matrices[a], self.matrices[b])
        self.known: dict[str, Matrix] = {}

    def of(self, symbols: str) -> Matrix:
        """The matrix of a chunk; those of short ones are kept, as many conversations share them."""
        if (got := self.known.get(symbols)) is None:
            text = symbols
            for symbol, pair in self.rules:
                text = text.replace(pair, symbol)
            got = product_of([self.matrices[c] for c in text])
            if len(symbols) <= 16 and len(self.known) < 100_000:
                self.known[symbols] = got
        return got


def illegal(symbols: str) -> int:
    """Neighbours whose roles' initials are none of su, ua and au."""
    roles = [(ord(c) - 97) // 3 for c in symbols]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(roles, roles[1:]))


_CHUNK = pa.struct([("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])
_CHUNK_DDL = "struct<costs:array<bigint>,audits:array<string>,illegal:bigint,first:string,last:string>"


def _chunk_matrices(batches: Iterator[pa.RecordBatch], rules: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    grammar = Grammar(rules)
    for batch in batches:
        out = []
        for symbols in batch.column(0).to_pylist():
            cells = [x for row in grammar.of(symbols) for x in row]
            out.append({"costs": [x and x[0] for x in cells], "audits": [x and flat(x[1]) for x in cells], "illegal": illegal(symbols), "first": symbols[0], "last": symbols[-1]})
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, _CHUNK)], [*batch.schema.names[1:], "m"])


def _verdict(chunks: list[dict] | None) -> tuple[int, int, str]:
    """(illegal, cost, audit) of a conversation's chunks in order."""
    parts = []
    for c in chunks or []:
        cells = [None if cost is None else (cost, audit) for cost, audit in zip(c["costs"], c["audits"], strict=True)]
        parts.append([cells[i : i + 4] for i in range(0, 16, 4)])
    whole = product(product_of(parts), insertions())
    best = None
    for j in ACCEPTED:
        best = better(best, whole[0][j])
    joints = sum(illegal(a["last"] + b["first"]) for a, b in zip(chunks or [], (chunks or [])[1:]))
    return sum(c["illegal"] for c in chunks or []) + joints, best[0], flat(best[1])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_verdict(x) for x in batch.column(0).to_pylist()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "illegal", "cost", "audit"])


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def analyse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", kept_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ordered, verdicts): the turns sorted as a written table, and for each conversation `conv`, gaps, blank, duplicate,
    truncated, illegal, cost and audit.

    A conversation's rows follow turn (nulls first); rows of one turn follow the digest of role and text, so copies are
    neighbours and reruns agree. A null role or text is one space, a null id is a conversation of its own. kept_col:
    rows that are not true there are no turns and only name their conversation, which has zeros and an empty audit if it
    has no others. Turns must be whole numbers. Further columns are left out. An empty table gives empty ones.
    """
    spark = turns.sparkSession
    small_batches(spark)
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    kept = F.coalesce(F.col(f"`{kept_col}`"), F.lit(False)) if kept_col else F.lit(True)
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), role.alias("role"), text.alias("text"), kept.alias("kept"))
    ordered = in_order(rows, ["conv", "turn", "digest"], "conversations")
    place = F.struct("__part", "__row")
    at = F.coalesce(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0))
    known = F.when((F.length("role") > 0) & (at > 0), at - 1).otherwise(len(INITIALS))
    slim = ordered.select("conv", "turn", "digest", "__part", "__row", "kept", known.alias("role"), (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
    slim = written(slim, "conversation-rows")
    firsts = slim.where("kept").groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    told = slim.join(firsts, slim["conv"].eqNullSafe(firsts["c"]) & (slim["digest"] == firsts["d"]), "left")
    copied = ~F.col("blank") & (place != F.col("first"))
    cut = F.col("cut") & ~F.col("blank") & ~copied
    fault = F.when(F.col("blank") | copied, GONE).when(cut, CUT).otherwise(FINE)
    told = written(told.select("conv", "turn", "__part", "__row", "kept", "blank", copied.alias("copied"), cut.alias("cut"), F.char((F.lit(97) + 3 * F.col("role") + fault).cast("bigint")).alias("symbol")), "conversation-faults")
    turn = F.when(F.col("kept"), F.col("turn"))
    span = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("bigint")
    sums = [F.count_if(F.col("kept") & F.col(c)).alias(name) for c, name in (("blank", "blank"), ("copied", "duplicate"), ("cut", "truncated"))]
    stats = told.groupBy("conv").agg(span.alias("gaps"), *sums)
    chunks = told.where("kept").groupBy("conv", "__part", F.floor(F.col("__row") / CHUNK).alias("__nth")).agg(F.sort_array(F.collect_list(F.struct("__row", "symbol"))).alias("s"))
    chunks = written(chunks.select(F.array_join("s.symbol", "").alias("symbols"), "conv", "__part", "__nth"), "conversation-chunks")
    rules = learn(chunks.groupBy("symbols").agg(F.count("*").alias("weight")))
    kind = chunks.schema["conv"].dataType.simpleString()
    made = chunks.mapInArrow(lambda b: _chunk_matrices(b, rules), f"conv {kind}, __part int, __nth bigint, m {_CHUNK_DDL}")
    whole = made.groupBy(F.col("conv").alias("c")).agg(F.sort_array(F.collect_list(F.struct("__part", "__nth", "m"))).alias("s")).select("c", F.col("s.m").alias("m"))
    each = stats.join(whole, stats["conv"].eqNullSafe(whole["c"]), "left").select("m", *stats.columns)
    ddl = f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return ordered, written(each.mapInArrow(_verdicts, ddl), "conversation-verdicts")


class Repair:
    """The repaired rows of one conversation, as its own rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2

    def due(self) -> str:
        return FULL["u" if (self.made - self.odd) % 2 == 0 else "a"]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self.due(), ""
            self.at, self.made = self.at + 1, self.made + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        if letter != "D":
            yield role if letter == "K" else self.due(), text
            self.made += 1
        self.at += 1


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(head, rows) of each conversation in turn; the rows must be used up before the next. A head starts a conversation."""
    rows = (r for b in batches for r in b.to_pylist())
    head = next(rows, None)
    while head is not None:
        after: list[dict] = []

        def repaired(audit=head["audit"], after=after):
            r = Repair(audit)
            for x in rows:
                if x["__part"] < 0:
                    after.append(x)
                    break
                yield from r.row(x["role"], x["text"])
            yield from r.inserted()

        yield head, repaired()
        head = after[0] if after else None


def _streams(ordered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each conversation's verdict, then its kept rows in order, all of it in one task."""
    heads = verdicts.select("*", F.lit(-1).alias("__part"), F.lit(-1).cast("bigint").alias("__row"))
    both = heads.unionByName(ordered.where("kept").select("conv", "__part", "__row", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "__part", "__row")


def repaired(ordered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv, place, role, text): the repaired turns, places from 0 in each conversation."""
    kind = verdicts.schema["conv"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, size = None, 256

        def all_rows():
            for head, turns in _walk(batches_seen()):
                for i, (role, text) in enumerate(turns):
                    yield head["conv"], i, role, text

        def batches_seen():
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv").type
                yield b

        def batch(part):
            c = list(zip(*part, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], conv_type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], ["conv", "place", "role", "text"])

        part = []
        for r in all_rows():
            part.append(r)
            if len(part) == size:
                yield batch(part)
                part = []
        if part:
            yield batch(part)

    return _streams(ordered, verdicts).mapInArrow(rows, f"conv {kind.simpleString()}, place bigint, role string, text string")


def with_digest(ordered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts with repaired_sha256: of the repaired `role:text`, newline-joined; of nothing where no row is left."""
    kind = verdicts.schema["conv"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def seen():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        def batch(heads):
            names = ["conv", *STATS, "audit"]
            return pa.RecordBatch.from_arrays([pa.array([h[n] for h in heads], schema.field(n).type) for n in names] + [pa.array([h["sha"] for h in heads], pa.string())], [*names, "repaired_sha256"])

        heads = []
        for head, turns in _walk(seen()):
            sha, lead = hashlib.sha256(), ""
            for role, text in turns:
                sha.update(f"{lead}{role}:{text}".encode())
                lead = "\n"
            heads.append(head | {"sha": sha.hexdigest()})
            if len(heads) == 256:
                yield batch(heads)
                heads = []
        if heads:
            yield batch(heads)

    return _streams(ordered, verdicts).mapInArrow(rows, f"conv {kind}, " + ", ".join(f"{c} bigint" for c in STATS) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kept) of conversations, damaged by what crc32 of `conv_id:turn` says; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(said("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("kept"), F.explode(copies).alias("copy")).drop("copy")


def op13(spark, sf_dir: str) -> DataFrame:
    out = with_digest(*analyse(damaged(table(spark, sf_dir, "conversations")), kept_col="kept"))
    return out.select(F.col("conv").alias("conv_id"), *STATS, "audit", "repaired_sha256")


def _add(entry: str, cost: str, letter: str) -> str:
    """An entry `000012KKD` of the SQL's table with a cost and a letter more; null stays null."""
    return f"(lpad((left({entry}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({entry}, 7) || '{letter}')"


_LAST = {"z": "z", "s": "s", "u": f"least(u, {', '.join(_add(x, str(INSERT), 'I') for x in 'zsa')})"}
_FROM = {"s": "z", "u": "zsa", "a": "u"}
_NEXT = {
    x: f"least({_add(x, str(DELETE), 'D')}"
    + "".join(f", CASE WHEN NOT gone AND initial = '{x}' THEN {_add(y, f'extra + {KEEP}', 'K')} END" + (f", CASE WHEN NOT gone THEN {_add(y, f'extra + {REROLE}', 'R')} END" if x in FULL else "") for y in _FROM.get(x, ""))
    + ")"
    for x in "zsua"
}
#: The same as a plain recursion over rows with the four states as columns: each the least of `cost, audit` as text.
OP13_SQL = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(key, '')])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS p FROM d),
f0 AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
f AS (SELECT conv_id, p, turn, role, text, initial, blank, NOT blank AND again AS copied, NOT blank AND NOT again AND cut AS cut, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut THEN {TRUNCATED} ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial AS pair FROM f0),
ids AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS p, '000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM ids UNION ALL
SELECT conv_id, p, {", ".join(f"{_NEXT[x]} AS {x}" for x in "zsua")} FROM (SELECT conv_id, f.p, z, s, u, least(a, {_add("u", str(INSERT), "I")}) AS a, gone, extra, initial FROM (SELECT conv_id AS c, p, {", ".join(f"{v} AS {x}" for x, v in _LAST.items())}, a FROM r) x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.c AND f.p = x.p + 1)),
ends AS (SELECT conv_id, max_by(least(z, a, {_add(_LAST["u"], str(INSERT), "I")}), p) AS best FROM r GROUP BY conv_id),
v AS (SELECT conv_id, left(best, 6)::BIGINT AS cost, substr(best, 7) AS audit FROM ends),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS pos FROM v WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS p, count(*) FILTER (letter <> 'D') OVER w - 1 AS made, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
text AS (SELECT x.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (made - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY pos) AS t FROM placed x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.p = x.p WHERE letter <> 'D' GROUP BY x.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (copied) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT v.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in STATS[:-1])}, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256 FROM v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN text x ON x.conv_id IS NOT DISTINCT FROM v.conv_id"""
