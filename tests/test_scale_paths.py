"""Paths that only large inputs take, forced on small ones and compared with brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskit.operators import packing, similarity, vectors
from corpuskit.operators.scan import ordered_scan, top_rows
from corpuskit.operators.skew import join_spread
from corpuskit.operators.substring import contains_join


@pytest.fixture(scope="module")
def steps(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", i, rng.choice([None, None, f"h{i}"]), rng.randint(0, 9)) for i in range(200)]
    return spark.createDataFrame(rows, "k string, pos int, mark string, n int")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan_over_buckets_equals_plain_window(steps, width):
    got = ordered_scan(steps, ["k"], ["pos"], F.floor(F.col("pos") / width), last={"last": F.col("mark")}, before={"prev": F.col("mark")}, total={"sum": F.col("n")})
    w = Window.partitionBy("k").orderBy("pos")
    want = steps.select("k", "pos", F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"),
                        F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
                        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    columns = ["k", "pos", "last", "prev", "sum"]
    assert [tuple(r) for r in got.select(columns).orderBy("k", "pos").collect()] == [tuple(r) for r in want.select(columns).orderBy("k", "pos").collect()]


def pack(tokens, limit):
    fill, opens = 0, []
    for run, tok in tokens:
        if opens and run != last:
            fill = 0
        last = run
        new = fill == 0 or fill + tok > limit
        opens.append(new)
        fill = tok if new else fill + tok
    return opens


@pytest.mark.parametrize("pages", [1, 3, 10_000])
def test_packing_across_buckets(spark, monkeypatch, pages):
    monkeypatch.setattr(packing, "PAGES_PER_BUCKET", pages)
    rng = random.Random(5)
    rows = [("d", page // 17, page, b, f"t{page}.{b}", rng.choice([1, 3, 9, 40, 130])) for page in range(60) for b in range(3)]
    blocks = spark.createDataFrame(rows, "doc string, run bigint, page bigint, block_idx int, text string, tokens int")
    got = packing.chunk_starts(blocks, 100).orderBy("page", "block_idx").collect()
    assert [r["opens"] for r in got] == pack([(r[1], r[5]) for r in rows], 100)
    packed = packing.pack_blocks(blocks, 100, smallest=1)
    assert packed.agg(F.sum("blocks")).first()[0] == len(rows)


def jaccard_pairs(sets, t):
    out = set()
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) / len(a | b) >= t:
                out.add((i, j))
    return out


@pytest.mark.parametrize("block_rows", [2, 20_000])
def test_set_similarity_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block_rows)
    rng = random.Random(11)
    base = [frozenset(rng.sample([f"w{k}" for k in range(40)], rng.randint(5, 15))) for _ in range(40)]
    sets = {}
    for i in range(160):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s.add(f"w{rng.randint(0, 45)}")
        sets[i] = frozenset(s)
    rows = [(i, f"r{i % 4}", sorted(s)) for i, s in sets.items()]
    found = similarity.similar_sets(spark.createDataFrame(rows, "item int, grp string, tokens array<string>"), 0.6)
    member = {r["item"]: r["set_id"] for r in found.members.collect()}
    linked = {frozenset((r["set_a"], r["set_b"])) for r in found.pairs.collect()}
    got = {(i, j) for i in sets for j in sets if i < j and (member[i] == member[j] or frozenset((member[i], member[j])) in linked)}
    want = jaccard_pairs(sets, 0.6)
    assert got == want
    cross = sum(1 for i, j in want if i % 4 != j % 4)
    assert similarity.cross_pair_counts(found).agg(F.sum("pairs")).first()[0] == cross
    best = {}
    for i, j in want:
        for a, b in ((i, j), (j, i)):
            if a % 4 != b % 4:
                s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                best.setdefault(a, []).append((-s, f"r{b % 4}", b))
    got_best = {}
    for r in similarity.top_partners(found, 3).collect():
        got_best.setdefault(r["item"], []).append((r["rank"], r["other_item"]))
    assert {k: [x[1] for x in sorted(v)] for k, v in got_best.items()} == {k: [x[2] for x in sorted(v)[:3]] for k, v in best.items()}


def test_blocked_vector_search_equals_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    vec = spark.createDataFrame([(i, f"c{i % 3}", f"r{i % 2}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)],
                                "vec_id bigint, collection string, repo string, embedding array<float>")
    ask = spark.createDataFrame([(i, None if i % 3 == 0 else f"r{i % 2}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(30)],
                                "query_id bigint, repo string, query_vec array<float>")

    def run():
        rows = vectors.nearest(vec, ask, {"c0": 4, "c1": 2}, same="repo", same_in=("c0",)).collect()
        return sorted((r["query_id"], r["grp"], r["rank"], r["vec_id"]) for r in rows)

    small = run()
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTORS_PER_PRODUCT", 25)
    assert run() == small
    assert len(small) == 30 * 6


def test_hot_key_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got = join_spread(big, one, ["k"], how)
        want = big.join(one, ["k"], how)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_contains_join(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    needles = words[:60]
    got = contains_join(spark.createDataFrame([(w,) for w in words], "hay string"), spark.createDataFrame([(w,) for w in needles], "needle string"))
    want = {(h, n) for h in words for n in needles if n in h and n != h}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_top_rows_prunes_before_the_shuffle(spark):
    df = top_rows(spark.range(1000).select((F.col("id") % 2).alias("k"), "id"), ["k"], [F.desc("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r["id"] for r in df.collect()) == [994, 995, 996, 997, 998, 999]


def test_char_windows_cover_the_text():
    rng = random.Random(1)
    words = iter(range(10_000, 99_999))
    text = "\n\n".join(" ".join(str(next(words)) for _ in range(rng.randint(5, 300))) for _ in range(12)) + " " + "".join(str(next(words)) for _ in range(500))
    parts = packing._windows(text, 1000, 200)
    assert all(0 < len(p) <= 1000 for p in parts)
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - 1000))
        assert found >= 0 and text[at:found].strip() == "" or found <= at
        at = found + len(p)
    assert text[at:].strip() == ""


def test_line_parts_repeat_first_line():
    text = "\n".join(["def f(a):"] + [f"    step {i} one two" for i in range(40)])
    parts = packing._line_parts(text, 40, 8)
    assert all(p.startswith("def f(a):") for p in parts)
    assert all(len(p.split()) <= 48 for p in parts)
    assert "\n".join(parts).count("step 39") == 1 and "step 0" in parts[0]
