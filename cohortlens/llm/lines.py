"""Fuzzy line deduplication, in DataFrame functions only.

Lines that differ a little (numbers, names, a word, a typing error) repeat across documents. Two lines are alike if the
sets of their character shingles, windows of WINDOW UTF-16 units at every place, have a Jaccard similarity of at least
`similarity`. A line's signature is a MinHash of one permutation: hashes are dealt to k places by some of their bits, and
each place has its least one. Each `run` of minima that follow each other make a band key; empty places are passed over,
so short lines have fewer minima and keys. Windows are rows of a generated-code stage, all of which are hashed; of a long
line only the least hashes, AHEAD a place on average, go on to the aggregate, as the others are hardly ever minima. It is taken over windows of WINDOW bytes of UTF-8: each lies within a window of as many characters, so lines alike in
characters are as alike in bytes, and in ASCII the two are the same. Bands only propose: every link is an exact Jaccard of the two lines' character shingles.
Linked lines are joined by distributed union-find, and of each component the first line stays.

Scale. Only bands that two different lines share are kept. Each line first meets two lines of its band, chosen by a hash
that tasks find before they shuffle, so a band that holds a third of all lines costs two rows a line, and most bands are
one component then. In the others every line outside the band's largest component meets every line of the band that is
in another component, so each two lines of a band are compared or linked already, however large it is. Those pairs are
no rows: the join's condition compares sketches, the parities of a line's shingles in FOLDED * 64 bits and then in
SKETCH * 64. In as many bits as sketches differ, sets differ at least, so none that is alike enough is passed over; what it lets through has its exact
Jaccard. Large bands are dealt in blocks of lines that meet each other, so no band is one task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import free_names, named, table, written
from cohortlens.llm.components import connected_components

WINDOW, SIMILARITY = 8, 0.8
#: Minima that follow each other in a key, and minima of a line: a pair at 0.8 shares a key in about 98 % of cases.
RUN, MINIMA = 3, 12
#: Hashes of a line that are looked at for each minimum, on average; a place has none of them in 2 % of cases.
AHEAD = 4
#: Words of 64 bits of a line's sketch, words that these are folded to, and lines of a block of a large band. The words
#: are an array and only the folded ones are columns: with a column a word, the JVM's compiler made 340 kB of one method of
#: the aggregate, in 9 s and in memory that no heap bounds.
SKETCH, FOLDED, BLOCK = 48, 16, 4096


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _hashes(data: Column, step: int, width: int) -> Column:
    """Hashes of the windows of `width` bytes of a binary at every step-th byte, or of the whole of a shorter one."""
    last = lambda u: F.greatest(F.lit(1), F.octet_length(u) - (width - 1))
    return _once(data, lambda u: F.transform(F.sequence(F.lit(1), last(u), F.lit(step)), lambda i: F.xxhash64(F.substring(u, i, F.lit(width)))))


def windows(line: Column) -> Column:
    """Hashes of a line's character shingles, repeats included."""
    return _hashes(F.encode(line, "UTF-16BE"), 2, 2 * WINDOW)


def _bands(minima: Column, run: int) -> Column:
    """The keys of each `run` neighbouring minima; fewer minima have one key."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(minima) - (run - 1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(minima, i, F.lit(run)), F.lit(0)))


def _lines(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """(columns..., pos, t, line, line2): lines that are not blank, lower-cased and trimmed, and two hashes of each."""
    raw = docs.select(*columns, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    raw = raw.where(F.trim("raw") != "")  # not of t, as a filter's expressions are computed again above it, lower() too
    return raw.withColumn("t", _normal(F.col("raw"))).drop("raw").withColumns({"line": F.xxhash64("t", F.lit(1)), "line2": F.xxhash64("t", F.lit(2))})


def line_keys(docs: DataFrame, text_col: str) -> DataFrame:
    """(line, keys): each different line, by its hash, with its band keys. No text is shuffled for it.

    Lines of under WINDOW bytes are one shingle, which no other line has, and aren't there.
    """
    run, k = RUN, MINIMA
    data = F.col("t").cast("binary")
    lines = _lines(docs, text_col).select("line", data.alias("data"), F.greatest(F.lit(0), F.octet_length(data) - (WINDOW - 1)).alias("n"))
    most = AHEAD * k
    share = F.coalesce((F.lit(float(most)) / F.col("n") * 2.0**64 - 2.0**63).cast("bigint"), F.lit(2**63 - 1))  # never null, or a filter of it goes beneath
    at = lines.withColumn("most", F.when(F.col("n") <= most, F.lit(2**63 - 1)).otherwise(share)).select("line", "data", "most", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), "n"))).alias("i"))
    least = at.select("line", "most", F.xxhash64(F.substring("data", F.col("i"), F.lit(WINDOW))).alias("h")).where("h <= most")
    dealt = least.select("line", "h", F.shiftright(F.col("h").bitwiseAND(F.lit(0xFFFF)) * k, 16).alias("place"))
    minima = dealt.groupBy("line").agg(*[F.min(F.when(F.col("place") == x, F.col("h"))).alias(f"m{x}") for x in range(k)])
    ms = [F.col(f"m{x}") for x in range(k)]
    full = F.array(*[F.xxhash64(*ms[x : x + run], F.lit(0)) for x in range(k - run + 1)])  # what _bands gives, as generated code
    some = _once(F.array_compact(F.array(*ms)), lambda m: _bands(m, run))
    return minima.select("line", F.when(sum(F.isnull(m).cast("int") for m in ms) == 0, full).otherwise(some).alias("keys"))


def shared_bands(keyed: DataFrame) -> DataFrame:
    """keyed (band, line) -> (band, line, p0, p1), of bands that different lines share, p0 and p1 being two lines of it.

    The few shared bands, each one row, are what is hashed: keyed, with ten rows a line, is not sorted for the join.
    """
    mixed = F.col("line").bitwiseXOR(F.col("band"))
    ends = keyed.groupBy("band").agg(F.min(mixed).alias("p0"), F.max(mixed).alias("p1")).where("p0 <> p1")
    ends = written(ends.select("band", *[F.col(p).bitwiseXOR(F.col("band")).alias(p) for p in ("p0", "p1")]), "line-bands")
    return written(keyed.join(ends.hint("shuffle_hash"), "band"), "line-band-members")


def first_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each line and the two lines of each of its bands."""
    pairs = members.select("line", F.explode(F.array("p0", "p1")).alias("other")).where("line <> other")
    return pairs.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")).distinct()


def mixed_bands(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, line, c, main, size, most): the lines of bands of several components, each with its component c, the band's
    largest one, and the lines of the band and of that. In bands of up to 3 lines all pairs are first pairs."""
    own = members.select("band", "line").join(labels, "line", "left").select("band", "line", F.coalesce("component", "line").alias("c"))
    own = written(own, "line-band-components")
    largest = own.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("m"))
    largest = largest.where("size > 3 and size > m.k").select("band", F.col("m.c").alias("main"), "size", F.col("m.k").alias("most"))
    return written(own.join(largest, "band"), "line-bands-mixed")


def sketched_words(texts: DataFrame) -> DataFrame:
    """(line, n, words, f0, f1, ...) of texts (line, t, n): in word i of the array, bit j is the parity of the shingles whose
    hash falls there; f0 and so on are the words at every FOLDED-th place in one, parities of fewer and larger parts.

    FOLDED words at a time are columns of one aggregate, so a line has few rows there, and no row for each of its words.
    """
    sets = texts.select("line", "n", F.array_distinct(windows(F.col("t"))).alias("hs"))  # beneath explode, which would compute it uncompiled
    at = sets.select("line", "n", F.explode("hs").alias("h")).select("line", "n", F.pmod(F.col("h"), F.lit(SKETCH)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))").alias("bit"))
    at = at.select("line", "n", F.floor(F.col("w") / FOLDED).cast("int").alias("part"), F.pmod("w", F.lit(FOLDED)).alias("j"), "bit")
    none = F.lit(0).cast("bigint")
    each = at.groupBy("line", "n", "part").agg(*[F.bit_xor(F.when(F.col("j") == x, F.col("bit"))).alias(f"x{x}") for x in range(FOLDED)])
    parts = each.select("line", "n", F.struct("part", F.array(*[F.coalesce(f"x{x}", none) for x in range(FOLDED)]).alias("ws")).alias("p"))
    held = parts.groupBy("line", "n").agg(F.map_from_entries(F.collect_list("p")).alias("m"))
    words = held.select("line", "n", F.concat(*[F.coalesce(F.try_element_at("m", F.lit(p)), F.array_repeat(none, FOLDED)) for p in range(SKETCH // FOLDED)]).alias("words"))
    fold = lambda j: reduce(lambda x, y: x.bitwiseXOR(y), [F.get("words", F.lit(i)) for i in range(j, SKETCH, FOLDED)])
    return words.select("line", "n", "words", *[fold(j).alias(f"f{j}") for j in range(FOLDED)])


def sketches(texts: DataFrame) -> DataFrame:
    """(line, n, s0, s1, ...) of texts (line, t, n): the sketches with a column a word."""
    return sketched_words(texts).select("line", "n", *[F.get("words", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)])


def other_pairs(mixed: DataFrame, sketched: DataFrame, similarity: float, block: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of lines of one band and different components, without those whose sketches show
    that they are not alike: the folded words first, then, where these let a pair through, all. A band's lines stand in
    blocks, and its blocks meet in twos."""
    parts = {"i": F.ceil((F.col("size") - F.col("most")) / block).cast("int"), "j": F.ceil(F.col("size") / block).cast("int")}

    def side(rows: DataFrame, own: str, other: str, names: dict) -> DataFrame:
        dealt = rows.withColumn(own, F.pmod(F.xxhash64("line", F.lit(3)), parts[own]).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), parts[other] - 1)))
        return dealt.join(sketched, "line").select("band", "i", "j", *[F.col(c).alias(names.get(c, f"{c}_b")) for c in ("line", "c", "n", *words)], *(["main"] if names else []))

    folded = [f"f{j}" for j in range(FOLDED)]
    words = ["words", *folded]
    a = side(mixed.where("c <> main"), "i", "j", {c: f"{c}_a" for c in ("line", "c", "n", *words)})
    b = side(mixed, "j", "i", {})
    n = F.col("n_a") + F.col("n_b")
    apart = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("main")) | (F.col("line_a") < F.col("line_b")))
    sized = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    bits = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    near = lambda differ: differ * (1 + similarity) <= (1 - similarity) * n + 1e-6
    few = near(reduce(add, (bits(F.col(f"{f}_a"), F.col(f"{f}_b")) for f in folded)))
    every = near(F.aggregate(F.zip_with("words_a", "words_b", bits), F.lit(0), add))
    on = (a["band"] == b["band"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & apart & sized & few & every
    return a.join(b, on).select(F.least("line_a", "line_b").alias("a"), F.greatest("line_a", "line_b").alias("b")).distinct()


def _texts(docs: DataFrame, text_col: str, lines: DataFrame) -> DataFrame:
    """(line, t, n) of lines (line), n the number of its shingles; different lines of one hash have none."""
    found = _lines(docs, text_col).select("line", "line2", "t").join(lines.hint("shuffle_hash"), "line", "left_semi")
    one = found.groupBy("line").agg(F.min("t").alias("t"), F.min("line2").alias("x"), F.max("line2").alias("y")).where("x = y")
    return written(one.select("line", "t", F.size(F.array_distinct(windows(F.col("t")))).alias("n")), "line-texts", compression="zstd")


def line_components(docs: DataFrame, text_col: str, similarity: float, block: int) -> DataFrame:
    """(line, component) of the lines of docs that are linked to others: all links between lines that share a band count."""
    keyed = written(line_keys(docs, text_col), "line-signatures").select(F.explode("keys").alias("band"), "line")
    members = shared_bands(keyed)
    pairs = written(first_pairs(members), "line-pairs")
    texts = _texts(docs, text_col, members.select("line").distinct())
    labels = connected_components(written(similar(pairs, texts, similarity), "line-links")).select(F.col("id").alias("line"), "component")
    mixed = mixed_bands(members, labels)
    sketched = written(sketched_words(texts.join(mixed.select("line").distinct(), "line", "left_semi")), "line-sketches")
    others = written(other_pairs(mixed, sketched, similarity, block).join(pairs, ["a", "b"], "left_anti"), "line-pairs")
    more = written(similar(others, texts, similarity), "line-links")
    ends = (labels.select(F.col("line").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    joined = more.join(next(ends), "a", "left").join(next(ends), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = connected_components(joined).select(F.col("id").alias("component"), F.col("component").alias("root"))
    whole = labels.join(over, "component", "left").select("line", F.coalesce("root", "component").alias("component"))
    alone = over.join(labels, "component", "left_anti").select(F.col("component").alias("line"), F.col("root").alias("component"))
    return written(whole.unionByName(alone), "line-components")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets have at least that Jaccard similarity. texts (line, t, n): a row a line.

    Texts are shuffled and not their sets, which are eight times as large.
    """
    a, b = (texts.select(F.col("line").alias(x), F.col("t").alias(f"t{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = pairs.join(a.select("a", "na"), "a").join(b.select("b", "nb"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    same = F.size(F.array_intersect(windows(F.col("ta")), windows(F.col("tb"))))
    alike = same * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-9
    return both.join(a.select("a", "ta"), "a").join(b.select("b", "tb"), "b").where(alike).select("a", "b")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(dk, id, drop): for each document with lines to drop, its key xxhash64(id, text), its id and the places of those lines.

    A line goes if an earlier line, by id (null first) and then place, is in its component; exact copies (case and edges
    aside) of any length are one line. Blank lines and null texts have no lines here and stay. Rows repeated with the
    same id and text count as one document. Lines are told apart by two 64-bit hashes; links between different lines
    are held by one of them, and lines that share it with another one have none.
    """
    places = _lines(docs, text_col, F.xxhash64(id_col, text_col).alias("dk"), F.col(id_col).alias("id")).drop("t")
    places = written(places, "line-places")
    labels = line_components(docs, text_col, similarity, block)
    copies = places.groupBy("line", "line2").agg(F.count("*").alias("k"))
    groups = copies.join(labels, "line", "left").where("component is not null or k > 1").select("line", "line2", F.coalesce("component", F.xxhash64("line", "line2")).alias("component"))
    groups = written(groups, "line-groups")
    found = written(places.join(groups.hint("shuffle_hash"), ["line", "line2"]).select("dk", "id", "pos", "component"), "line-found")
    order = F.struct(F.col("id").isNotNull().alias("x"), "id", "dk", "pos")
    first = written(found.groupBy("component").agg(F.min(order).alias("f")).select("component", F.col("f.dk").alias("fdk"), F.col("f.pos").alias("fpos")), "line-first")
    drops = found.join(first, "component").where("not (dk = fdk and pos = fpos)")
    return drops.groupBy("dk", "id").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def _with_drops(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """rows, which are those of docs with __dk (the key) and __own (the id), and __drop, the places of the lines that go (null: none)."""
    drops = written(repeated_lines(docs, id_col, text_col, **options), "line-drops").select(F.col("dk").alias("__key"), F.col("id").alias("__id"), F.col("drop").alias("__drop"))
    same = (F.col("__dk") == F.col("__key")) & F.col("__own").eqNullSafe(F.col("__id"))
    return rows.join(drops, same, "left").drop("__key", "__id", "__dk", "__own")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """(keep..., n_lines, dropped): a row a row of docs, with the places (from 0) of the lines that go.

    A null text has 0 lines. Names in keep may not be n_lines or dropped, nor start with two underscores (ValueError). Options are
    those of repeated_lines.
    """
    keep = [id_col] if keep is None else keep
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n")))
    free_names(keep, ["n_lines", "dropped"])
    rows = docs.select(*[named(c) for c in keep], n_lines.alias("n_lines"), F.xxhash64(id_col, text_col).alias("__dk"), F.col(id_col).alias("__own"))
    return _with_drops(docs, rows, id_col, text_col, options).select(*[named(c) for c in rows.columns[:-2]], F.coalesce("__drop", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped"), **options) -> DataFrame:
    """docs with the repeated lines taken out of the text, and two counts: lines before, and lines dropped (0 and 0 for a null text).

    One row in, one row out; a text whose lines all went is empty. Other columns stay; the counts replace columns of
    their names, which may be chosen. Names may not start with two underscores. Options are those of repeated_lines.
    """
    own = [c for c in docs.columns if c not in counts]
    rows = docs.withColumns({"__dk": F.xxhash64(id_col, text_col), "__own": F.col(id_col)})
    d = _with_drops(docs, rows, id_col, text_col, options)
    lines = F.split(F.col(text_col), "\n")
    kept = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__drop", i)), "\n"))
    n = {counts[0]: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)), counts[1]: F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop"))}
    return d.select(*[kept.alias(c) if c == text_col else named(c) for c in own], *[v.alias(c) for c, v in n.items()])


def op3(spark, sf_dir: str) -> DataFrame:
    out = dropped_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped")
