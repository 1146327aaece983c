"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into segments, fewer than the bits that may differ: of two
fingerprints with at most three differing bits, one half differs by at most one.  Every
segment is indexed as it is; every fingerprint also asks for its segments with
one set bit deleted.  An equality join on segment values brings together the
pairs that agree there but for one bit, and only those are verified.  Equal
fingerprints are folded first, so copies never meet.

The pipeline's stage (``drop_near_duplicates``) owes every pair of similar
shingle sets, which fingerprints alone cannot give: there the same signatures
bring most near copies together, the sets verify them, and an exact join over
the rarest shingles finds what is still apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuskit.llm.components import components
from corpuskit.operators.bitmaps import hits_of, map_of
from corpuskit.operators.scan import top_rows
from corpuskit.operators.sketches import parities
from corpuskit.session import materialize

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BLOCK = 1 << 16
CUTS = (32, 32)
MAX_BITS = 3
# Near copies: sets of 5-word shingles with a Jaccard similarity of at least SHARE = 4/5.
NEAR_SIZE, SHARE = 5, (4, 5)
#: Prefixes are longer by one shingle in so many, so similar sets share that many more of them;
#: two sets that meet by chance share ``FEW`` at least before they are compared ahead of the exact join.
PART, FEW = 20, 3
#: How many other sets, of those it shares most with, a set is compared with ahead of the exact join.
POLES = 2
#: One text in so many is read for common shingles; so many of them come last in the order.
SAMPLE, COMMON = 16, 1 << 18
#: Parities of a set of shingles that go with its rows of the exact join, in words of 64 bits.
SKETCH_WORDS = 8


def shingles(text: str, size: int) -> list[str]:
    """Word shingles with repeats; a shorter text is one shingle, no words none."""
    found = _WORD.findall(text.translate(_LOWER))
    if len(found) < size:
        return [" ".join(found)] if found else []
    return [" ".join(found[i : i + size]) for i in range(len(found) - size + 1)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; 0 for no words."""
    parts = shingles(text or "", size)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(parts), _BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in parts[i : i + _BLOCK]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(parts), bitorder="little").view("<i8")[0])


def shingle_set(text: str | None, size: int = NEAR_SIZE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    parts = shingles(text or "", size)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in parts), np.uint64, len(parts))
    return np.unique(hashes.view(np.int64))


def with_fingerprints(docs: DataFrame, size: int = 3, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint of each whole text."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.withColumn(name, of(F.col(text_col)))


def links(prints: DataFrame, node: str = "fp", words: tuple[str, ...] = ("fp",), cuts: tuple[int, ...] = CUTS, bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(u, v)`` of ``node`` whose fingerprints differ in at most ``bits``, each once.

    A fingerprint is the 64-bit ``words``, each cut into segments of the widths
    ``cuts``.  All pairs are found if ``bits`` is below twice the number of
    segments; beyond that, those with a segment that differs by at most one bit.
    """
    places = [(w, sum(cuts[:i]), cuts[i]) for w in words for i in range(len(cuts))]
    part = lambda c, at, width: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1))
    pick = lambda side: [F.col(w).alias(f"{side}{i}") for i, w in enumerate(words)]
    keys = F.array(*[F.struct(F.lit(s).alias("s"), part(F.col(w), at, width).alias("x"), F.lit(width).alias("width")) for s, (w, at, width) in enumerate(places)])
    index = prints.select(F.col(node).alias("u"), *pick("u"), F.explode(keys).alias("k")).select("u", *[f"u{i}" for i in range(len(words))], "k.s", "k.x")
    one = lambda x, s, same: F.struct(s.alias("s"), x.alias("x"), F.lit(same).alias("same"))
    deleted = F.flatten(F.transform(keys, lambda k: F.concat(
        F.array(one(k["x"], k["s"], True)),
        F.transform(
            F.filter(F.sequence(F.lit(0), k["width"] - 1), lambda i: F.call_function("getbit", k["x"], i) == 1),
            lambda i: one(k["x"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), k["s"], False),
        ),
    )))
    asked = prints.select(F.col(node).alias("v"), *pick("v"), F.explode(deleted).alias("k")).select("v", *[f"v{i}" for i in range(len(words))], "k.s", "k.x", "k.same")
    differ = {w: F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}")) for i, w in enumerate(words)}
    close = sum((F.bit_count(d) for d in differ.values()), F.lit(0)) <= bits
    # A pair that agrees but for a bit in several segments is taken from the first.
    for s, (w, at, width) in enumerate(places[:-1]):
        close &= (F.col("s") <= s) | (F.bit_count(part(differ[w], at, width)) > 1)
    once = ~F.col("same") | (F.col("u") < F.col("v"))
    return index.join(asked, ["s", "x"]).where(once & close).select("u", "v")


def classes(prints: DataFrame) -> DataFrame:
    """``fp`` and ``component_id`` of every distinct fingerprint.

    ``prints`` has ``fp`` and ``first_id``, the smallest id that has it.
    """
    roots = components(links(prints), "simhash")
    of = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return of.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` per row of ``docs``.

    Fingerprints with three or fewer differing bits are linked; a component's
    id is the smallest id in it.  NULL, empty and blank texts have fingerprint
    zero and are linked like any other.  Repeated rows stay repeated; a NULL id
    counts for no component's id, which is NULL if all its ids are.  Other
    columns are ignored, an empty table gives an empty table.
    """
    slim = materialize(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size).select("id", "fp"), "fingerprints")
    prints = materialize(slim.groupBy("fp").agg(F.min("id").alias("first_id")), "fingerprints")
    found = slim.join(classes(prints), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _majority(blocks: Iterable[np.ndarray]) -> int:
    """A bit is 1 if over half of all hashes have it; 0 for none."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come more than once in a sample of ``texts (h, text)``, sorted, and how often.

    They only set an order, so what the sample misses costs time, never a pair.
    """
    @pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t) for t in texts])

    some = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).select(F.explode(of("text")).alias("token"))
    often = some.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).collect()
    tokens, counts = np.array([r[0] for r in often], np.int64), np.array([r[1] for r in often], np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``place`` may be one of ``wanted``, so that a join need not move the others."""
    bits = rows.sparkSession.sparkContext.broadcast(map_of(wanted, "place"))

    @pandas_udf("boolean")
    def has(place: pd.Series) -> pd.Series:
        return pd.Series(hits_of(bits.value, place.to_numpy()))

    return rows.where(has("place"))


def _held(column: str, tokens: DataFrame) -> Column:
    """An array column without what can't be one of ``tokens``."""
    bits = tokens.sparkSession.sparkContext.broadcast(map_of(tokens, "token"))

    @pandas_udf("array<int>")
    def of(arrays: pd.Series) -> pd.Series:
        return pd.Series([a[hits_of(bits.value, a.astype(np.int64))] for a in arrays], dtype=object)

    # Else the filter that comes with an explode works it out once more.
    return of.asNondeterministic()(column)


def _similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the ``pairs (u, v)`` of nodes whose shingle sets are similar, by the sets themselves.

    ``prints`` has ``node``, ``k1``, ``k2`` and ``best``; ``texts`` has ``id``, ``h``
    and ``text``.  Of copies, one text is read again; its set moves once, and
    once more for each pair to the set it is compared with.
    """
    num, den = SHARE

    @pandas_udf("k1 long, k2 long, tokens array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"k1": [_digest(s)[0] for s in sets], "k2": [_digest(s)[1] for s in sets], "tokens": sets})

    # Else the join's filter for NULL keys is moved below and makes the sets of all texts, ahead of the picked ones.
    of = of.asNondeterministic()
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    place = F.xxhash64("best.id", "best.h").alias("place")
    placed = materialize(prints.select("node", "k1", "k2", "best").join(nodes, "node").select("node", "k1", "k2", place), "near-nodes")
    read = _picked(texts.withColumn("place", F.xxhash64("id", "h")), placed).select("place", of("text").alias("s")).select("place", "s.*")
    # The digest names the set, so another text of the same place does no harm.  Both sides below are one shuffle.
    sets = read.join(placed, ["place", "k1", "k2"]).groupBy("node").agg(F.any_value("tokens").alias("tokens"))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("n", F.size(F.array_intersect("u_tokens", "v_tokens")))
    return both.where(F.col("n") * den >= (F.size("u_tokens") + F.size("v_tokens") - F.col("n")) * num).select("u", "v")


def signature_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of nodes by deletion variants of their fingerprints: each node and one that has the segment it asks for.

    A group in which all have a segment in common gives one pair a node, not all pairs.
    """
    part = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    keys = F.array(*[F.struct(F.lit(s).alias("s"), part(sum(CUTS[:s]), w).alias("x"), F.lit(w).alias("width")) for s, w in enumerate(CUTS)])
    one = lambda x, s: F.struct(s.alias("s"), x.alias("x"))
    variants = F.flatten(F.transform(keys, lambda k: F.concat(F.array(one(k["x"], k["s"])), F.transform(
        F.filter(F.sequence(F.lit(0), k["width"] - 1), lambda i: F.call_function("getbit", k["x"], i) == 1),
        lambda i: one(k["x"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), k["s"])))))
    have = prints.select("node", "fp", F.explode(keys).alias("k")).groupBy("k.s", "k.x").agg(F.min(F.struct("node", "fp")).alias("pole"))
    asked = prints.select("node", "fp", F.explode(variants).alias("k")).select("node", "fp", "k.s", "k.x").join(have, ["s", "x"])
    close = (F.col("node") != F.col("pole.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pole.fp"))) <= MAX_BITS)
    return asked.where(close).select(F.least("node", "pole.node").alias("u"), F.greatest("node", "pole.node").alias("v")).distinct()


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist())


def _least(n: Column) -> Column:
    """Shingles that the prefix of a set of ``n`` shares at least with one as similar and not smaller.

    One less than that, as two shingles of a set may have the same short hash.
    """
    return F.greatest(F.floor(n / PART), F.lit(1))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their node."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _poled(shared: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Pairs ``(u, v)``: each set and the few, in other components, that it shares most shingles with.

    A shingle offers the two sets that hold most of what is common: where copies
    were edited each in its own way, these are the ones all others are near to.
    """
    own = shared.withColumn("root", F.col("node")) if roots is None else _rooted(shared, roots)
    end = F.struct("common", "node", "root")
    most = own.groupBy("token", "band").agg(F.max(end).alias("first"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # The second is of another component than the first, so the first's own has one to meet as well.
    other = own.join(most.select("token", "band", F.col("first.root").alias("taken")), ["token", "band"]).where("root <> taken")
    poles = most.join(other.groupBy("token", "band").agg(F.max(end).alias("second")), ["token", "band"])
    met = own.join(poles, ["token", "band"]).select("node", "n", "root", F.explode(F.array("first", "second")).alias("pole")).where("root <> pole.root")
    met = met.groupBy("node", F.col("pole.node").alias("pole")).agg(F.count("*").alias("times"), F.max("n").alias("n"))
    few = met.where(F.col("times") >= F.least(F.lit(FEW), _least(F.col("n"))))
    return top_rows(few, ["node"], [F.desc("times"), F.col("pole")], POLES).select(F.least("node", "pole").alias("u"), F.greatest("node", "pole").alias("v")).distinct()


def _apart(shared: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs ``(u, v)`` that may be similar and are in different components.

    Sets outside the largest component of a shingle meet all sets of other components.
    Their sketches end in the join those that only have a common passage.
    """
    num, den = SHARE
    apart = materialize(_rooted(shared, roots), "near-apart")
    cells = apart.groupBy("token", "root").agg(F.count("*").alias("rows"))
    main = cells.groupBy("token").agg(F.max(F.struct("rows", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    mixed = apart.join(main, "token").join(sketches.select("node", "sketch"), "node")
    side = lambda df, c, *more: df.select("token", *more, *[F.col(x).alias(f"{c}_{x}") for x in ("node", "n", "root", "sketch")])
    # Sets differ in at least as many shingles as their sketches differ in places.
    differ = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    # Sizes of similar sets lie in the same or in neighbouring bands.
    asking = side(mixed.where("root <> main"), "a", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = asking.join(side(mixed, "b", "band"), ["token", "band"]).where(
        "a_root <> b_root"
        f" and a_n * {den} >= b_n * {num} and b_n * {den} >= a_n * {num}").where(
        differ * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num))
    pairs = pairs.groupBy(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).agg(
        F.count_distinct("token").alias("times"), F.min(F.least("a_n", "b_n")).alias("n"))
    return pairs.where(F.col("times") >= _least(F.col("n"))).select("u", "v")


def near_roots(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, root)``: components of all pairs of ``prints`` with a similarity of at least ``SHARE``.

    ``prints`` has ``node``, ``k1``, ``k2``, ``n``, ``fp``, ``prefix``, ``sketch`` and ``best``;
    ``texts`` has ``id``, ``h`` and ``text``.  Similar sets share as many shingles
    of their prefixes as the smaller ``_least`` of the two.  Deletion variants of
    the fingerprints link what they can, and each set meets the few others it
    shares most with; both join large groups in a linear number of pairs.  Then
    all pairs that are still in different components and share enough of their
    prefixes meet, so no pair is missed and no group is spelled out.  Every pair
    is verified on the sets.
    """
    num, den = SHARE
    every = prints.select(F.explode("prefix").alias("token"), "node")
    # Few shingles of a prefix are anywhere else; the others are left out before anything is moved by them.
    twice = materialize(every.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "near-tokens")
    known = prints.select("node", "n", _held("prefix", twice).alias("prefix"))
    spread = known.select("node", "n", F.explode("prefix").alias("token"))
    shared = spread.join(twice, "token").withColumn("band", F.floor(F.log("n") / math.log(den / num) + 1e-9).cast("int"))
    common = shared.groupBy("node").agg(F.sum("rows").alias("common"))
    shared = materialize(shared.drop("rows").join(common, "node"), "near-shared")
    tried = signature_pairs(prints.where("n > 0")).unionByName(_poled(shared)).distinct()
    tried = materialize(tried, "near-met")
    found = materialize(_similar(tried, prints, texts), "near-links")
    more = materialize(_poled(shared, components(found, "near-roots")).join(tried, ["u", "v"], "left_anti"), "near-met")
    found, tried = found.unionByName(materialize(_similar(more, prints, texts), "near-links")), tried.unionByName(more)
    pairs = materialize(_apart(shared, components(found, "near-roots"), prints).join(tried, ["u", "v"], "left_anti"), "near-met")
    return components(found.unionByName(_similar(pairs, prints, texts)), "near-roots")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near copies, with their columns as they were.

    Texts are linked if the sets of their 5-word shingles have a Jaccard
    similarity of at least 0.8; all such links are found, and none else.  The
    row with the smallest id stays; a NULL id comes last, ties go by a hash of
    the text, equal rows by chance.  Texts without words are copies of each
    other.  An empty table gives an empty table.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("id"), hashed.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(texts))

    # A token of a prefix is 32 bits of its shingle's hash: it only says which sets may be similar.
    @pandas_udf("k1 long, k2 long, n int, fp long, prefix array<int>, sketch array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        tokens, counts = common.value
        out = []
        for text in texts:
            own = shingle_set(text)
            at = np.minimum(np.searchsorted(tokens, own), max(0, len(tokens) - 1))
            weight = np.where(tokens[at] == own, counts[at], 0) if len(tokens) else np.zeros(len(own), np.int64)
            keep = len(own) + -len(own) * SHARE[0] // SHARE[1] + 1 + len(own) // PART if len(own) else 0
            out.append((*_digest(own), len(own), _majority([own]), own[np.argsort(weight, kind="stable")[:keep]].astype(np.int32), parities(own, SKETCH_WORDS)))
        return pd.DataFrame(out, columns=["k1", "k2", "n", "fp", "prefix", "sketch"])

    slim = docs.select(F.col(id_col).alias("id"), hashed.alias("h"), of(F.col(text_col)).alias("s")).select("id", "h", "s.*")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best")
    prints = slim.groupBy("k1", "k2").agg(best, F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("prefix").alias("prefix"), F.any_value("sketch").alias("sketch"))
    prints = materialize(prints.select(F.monotonically_increasing_id().alias("node"), "*"), "near-prints")
    of_node = prints.select("node", "best").join(near_roots(prints, texts), "node", "left")
    stay = of_node.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.*")
    # NULL ids are joined as well: by a flag and a value that stands for them.
    keys = lambda c, h: {"__none": c.isNull(), "__id": F.coalesce(c.cast("string"), F.lit("")), "__h": h}
    stay = stay.select(*[v.alias(k) for k, v in keys(F.col("id"), F.col("h")).items()]).distinct()
    kept = docs.select(F.struct(*docs.columns).alias("__row"), *[v.alias(k) for k, v in keys(F.col(id_col), hashed).items()]).join(stay, ["__none", "__id", "__h"])
    # Equal rows come to the same key; one of them stays.
    number = F.row_number().over(Window.partitionBy("__none", "__id", "__h").orderBy("__h"))
    return kept.withColumn("__n", number).where("__n = 1").select("__row.*")
