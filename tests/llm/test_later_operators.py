"""Hard negatives, the Merkle manifest and the quality classifier beside loops, with odd rows."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.llm import hard_negatives, merkle, quality, queries

# 11 hard negatives


def mined(rows, positives=5, negatives=5):
    """Loops over distinct anchors: ids divisible by 10."""
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  missing components are 0
    for i, label, vector in {r for r in rows if r[0] % 10 == 0}:
        others = sorted((-dot(vector, v), j, l) for j, l, v in rows if j != i)
        for score, j, _ in [o for o in others if o[2] == label][:positives]:
            inside = [o for o in others if o[2] != label and 80 * -score <= 100 * -o[0] <= 100 * -score]
            for rank, (other, k, _) in enumerate(inside[:negatives], 1):
                out[(i, j, rank, k, -score, -other)] += 1
    return out


@pytest.mark.parametrize("most", [9, 100_000])
def test_hard_negatives_equal_loops(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.randrange(3), tuple(rng.randint(-most, most) for _ in range(6))) for i in range(120)]
    rows += [(200 + i, 1, (most, 0, 0, 0, 0, 0)) for i in range(40)]  # copies: ties by id
    rows += [(10, rows[10][1], rows[10][2]), (31, *rows[31][1:]), (20, 2, (1, 2)), (30, 0, ()), (77, 1, (0,) * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, vector array<bigint>")
    for block, group in ((4096, 2048), (17, 3)):
        got = hard_negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0, block=block, group=group)
        assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_packed_scores_are_exact():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 1), (3, 5), (64, 160), (7, 1 << 20), (5, 1 << 29)):
        a, c = rng.integers(-most, most + 1, (9, dims)), rng.integers(-most, most + 1, (31, dims))
        a[0], c[0], c[1] = most, most, -most
        fields = hard_negatives.Fields(dims, most, most)
        expected = c.astype(object) @ a.astype(object).T
        assert (fields.scores(c, a) == expected).all()
    assert hard_negatives.Fields(64, 160, 160).count == 2 and hard_negatives.Fields(3, 5, 5).count > 4


def test_rows_that_take_no_part(spark):
    odd = [
        (None, [1.0], 1), (1, None, 1), (2, [1.0], None), (3, [None], 1), (4, [float("nan")], 1), (5, [float("inf")], 1),
        (100, [0.5, -0.001], 1), (6, [1e30], 1), (7, [], 1), (8, [0.25], 1),
    ]
    df = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit(1))
    vectors = hard_negatives.quantised(df)
    assert {r.vec_id: r.vector for r in vectors.collect()} == {100: [128, -1], 6: [(1 << 63) - 1], 7: [], 8: [64]}
    assert hard_negatives.mine(vectors, F.col("vec_id") == 100).count() == 0  # no other label
    two = spark.createDataFrame([(100, [0.5], 1), (8, [0.25], 1), (9, [0.25], 2)], df.schema.simpleString()[7:-1].replace(":", " ").replace(",score int", ""))
    assert [tuple(r) for r in hard_negatives.mine(hard_negatives.quantised(two), F.col("vec_id") == 100).collect()] == [
        (100, 8, 1, 9, 8192, 8192)
    ]
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") == 100).count() == 0


# 12 Merkle manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf the digests before and after it, level by level."""
    paths, nodes = [[] for _ in leaves], list(leaves)
    at = list(range(len(leaves)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run, k = nodes[place // 3 * 3 : place // 3 * 3 + 3], place % 3
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], paths


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def manifest(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        mine = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (mine, *tree([leaf(r) for r in mine]))
    root, tops = tree([trees[s][1] for s in order])
    out = Counter()
    for source, top in zip(order, tops):
        mine, subroot, paths = trees[source]
        for row, path in zip(mine, paths):
            out[(row[0], leaf(row), subroot, root, tuple(path + top))] += 1
    return out


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def manifested(df):
    got = merkle.manifest(df, F.col("text")).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.steps)) for r in got)


def test_manifest_equals_recursion(spark):
    rows = [(i, "s", "en", i % 7, f"text {i}\nä") for i in range(1000)]  # more than a piece of leaves
    rows += [(i, s, None, None, None) for s in (None, "", "é", "z") for i in range({"z": 1}.get(s, 5))]
    rows += [(None, "z", "en", 1, "x"), (3, "z", "en", 1, ""), (3, "z", "en", 1, "b"), (3, "z", "en", 1, "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = df.withColumns({c: F.lit(1) for c in ("tree", "place", "size", "digest", "steps", "piece", "part", "root")})
    expected = manifest(rows)
    assert manifested(clash) == expected
    one = [(7, None, None, None, "alone")]
    assert manifested(spark.createDataFrame(one, SCHEMA)) == manifest(one)
    assert merkle.manifest(df.limit(0), F.col("text")).count() == 0


def test_only_untampered_rows_are_verified(spark):
    rows = [(i, f"s{i % 4}", "en", 3, "a\nb" if i % 3 else "ab") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    proofs = merkle.manifest(df, F.translate("text", "\n", ""))
    got = proofs.select("doc_id", (merkle.folded(F.col("changed"), F.col("steps")) == F.col("root")).alias("ok"))
    assert {r.doc_id: r.ok for r in got.collect()} == {i: i % 3 == 0 for i in range(90)}


# 13 quality classifier


def test_contexts_equal_loops():
    rng = np.random.default_rng(3)
    index = quality.index_vectors(50, 8)
    ends = np.array([0, 1, 1, 40, 43, 300])
    tokens = rng.integers(0, 50, 300).astype(np.uint16)
    sums, counts = np.zeros((50, 8), np.int64), np.zeros(50, np.int64)
    quality.add_contexts(sums, counts, tokens, ends, index)
    expected, since = np.zeros_like(sums), 0
    for end in ends:
        for i in range(since, end):
            for j in range(max(since, i - 2), min(end, i + 3)):
                if i != j:
                    expected[tokens[i]] += index[tokens[j]]
        since = end
    assert (sums == expected).all() and (counts == np.bincount(tokens, minlength=50)).all()
    assert (np.abs(index[:50]).sum(axis=1) <= quality.NONZERO).all() and not index[50].any()


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op13_quality_classifier"](spark, sf).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_of_odd_tables(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["$$$", "!!", "||"]) + "X" for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    rows += [(None, "one two"), (500, None), (501, ""), (502, "one " * 200_000), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("x") for c in ("vector", "score", "bucket", "n", "quality", "held_out")}
    )
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (7, None, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[500][0].score == by[501][0].score and by[1][0] == by[1][1]
    assert all(by[i][0].predicted == i % 2 for i in range(200))
    # Other partitions, same scores.
    again = {r.doc_id: r.score for r in quality.classify(df.repartition(7), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.classify(df, labels.where("quality = 1")).collect()} == {1}
    assert quality.classify(df.limit(0), labels).count() == 0
