"""The operators beside brute force, on a small corpus with odd rows and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridpanel.llm import (
    decontaminate,
    exact_dedup,
    jaccard,
    language,
    licenses,
    mixing,
    scratch,
    sharding,
    substrings,
    token_counts,
    warc,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHING = ("row", "class", "n", "size", "shard", "h", "key", "digest", "content", "number", "comp", "node")


def documents(spark, rows):
    langs = ["en", "fr", None]
    return spark.createDataFrame(
        [(i, t, langs[(i or 0) % 3], None if (i or 0) % 11 == 0 else f"s{(i or 0) % 4}", len(t or "")) for i, t in rows],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def corpus():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    wide = documents(spark, corpus).repartition(3)
    for name in CLASHING:
        wide = wide.withColumn(name, F.lit("own"))
    return wide


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, []).repartition(2)


@pytest.fixture(scope="module")
def ragged(spark):
    """Nulls in every column, repeated rows and repeated ids."""
    rows = [(None, None), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (2, None)]
    return documents(spark, rows).union(spark.createDataFrame([(None,) * 5], SCHEMA))


# 1 token counts


def greedy(first, rest, word):
    count, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        count, at, pieces = count + 1, end, rest
    return count


def test_automaton_equals_longest_match():
    rng = random.Random(0)
    piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
    for _ in range(400):
        first, rest = ({piece() for _ in range(rng.randrange(1, 9))} for _ in range(2))
        made = token_counts.Automaton(first, rest)
        for _ in range(25):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            assert made.count(word) == greedy(first, rest, word), (first, rest, word)


def test_token_counts_of_documents(docs, corpus, empty, ragged, tmp_path):
    import base64

    pieces = [bytes([b]) for b in range(256)] + [b" w", b" w1", b"w1", b"23", b" long", b" a", b"yyyy"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    first, rest = map(set, token_counts.pieces_of_ranks(str(path)))
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, str(path)).collect()}
    for doc_id, text in corpus:
        found = (text or "").encode().split()
        assert got[doc_id].n_words == len(found)
        if len(text or "") < 10_000:
            assert got[doc_id].n_tokens == sum(greedy(first, rest, b" " + w) or 1 for w in found)
    assert token_counts.count_tokens(empty, str(path)).count() == 0
    assert token_counts.count_tokens(ragged, str(path)).count() == 7


# 2 substring dedup


def test_repeated_passages_leave_all_but_the_first(spark, empty, ragged):
    rng = random.Random(5)
    sentence = lambda n: " ".join(brute.prose(rng, n, 10**6).split()).replace(".", "") + "."
    passage = " ".join(sentence(9) for _ in range(7))
    rows = [(i, "\n".join([sentence(12), sentence(15), passage if i % 3 == 0 else sentence(30), sentence(14)])) for i in range(12)]
    rows.append((100, passage))
    unmarked = " ".join(f"u{i}" for i in range(70))
    rows.append((101, unmarked))
    rows.append((102, unmarked))
    got = {r.doc_id: r for r in substrings.deduplicate(documents(spark, rows)).collect()}
    for doc_id, text in rows:
        if doc_id % 3 == 0 and 0 < doc_id < 12:
            assert got[doc_id].text == text.replace(passage + "\n", "")
            assert got[doc_id].first_docs == [0]
        elif doc_id == 100:
            assert got[doc_id].text == ""
        elif doc_id == 102:
            assert got[doc_id].text == "" and got[doc_id].first_docs == [101]
        else:
            assert got[doc_id].text == text and got[doc_id].n_removed == 0
    assert substrings.deduplicate(empty).count() == 0
    assert substrings.deduplicate(ragged).count() == 7


def test_spans_equal_loops(docs, corpus):
    """Covered sentences by the definition, spelled out over strings."""

    def sentences(text):
        out, gap = [], True
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
            if out and not gap and not re.search(r"[\n\r]", (text or "")[last : m.start()]):
                out[-1].append(m[0].lower())
            else:
                out.append([m[0].lower()])
            gap, last = m[0][-1] in ".!?", m.end()
        return out

    small = [(i, t) for i, t in corpus if t is None or all(len(s) <= substrings.LONG for s in sentences(t))]
    seen = defaultdict(list)
    for doc_id, text in small:
        found = sentences(text)
        for at in range(len(found)):
            for end in range(at + 1, len(found) + 1):
                run = [w for s in found[at:end] for w in s]
                if end - at >= 3 and len(run) >= 10 or len(run) >= 50:
                    seen[tuple(run)].append((doc_id, at, end))
                    break
    covered = defaultdict(set)
    for places in seen.values():
        for doc_id, at, end in sorted(places)[1:]:
            covered[doc_id] |= set(range(at, end))
    ids = [i for i, _ in small]
    got = substrings.deduplicate(docs.where(F.col("doc_id").isin(ids))).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: len(covered[i]) for i in ids}


def test_passages_in_running_text_are_found(spark):
    """A passage of 64 words without marks, set into other running text, loses words wherever it stands."""
    rng = random.Random(31)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(64))
    around = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, " ".join([around(i % 9 * 5), passage, around(i % 7 * 6)]).strip()) for i in range(63)]
    rows += [(100 + i, f"{around(5)}. {passage}. {around(5)}") for i in range(5)]
    got = {r.doc_id: r for r in substrings.deduplicate(documents(spark, rows)).collect()}
    assert got[0].n_removed == 0
    assert [(i, got[i].n_removed, got[i].first_docs) for i, _ in rows if i and (got[i].n_removed < 3 or got[i].first_docs[0] != 0)] == []


def test_scripts_without_blanks_have_spans(spark):
    rng = random.Random(32)
    run = lambda lo, hi, n: "".join(chr(rng.randrange(lo, hi)) for _ in range(n))
    han = [run(0x4E00, 0x9F00, 12) + mark for mark in "。！？。"]
    thai = run(0x0E01, 0x0E2E, 150)
    hindi = " ".join(" ".join(run(0x0915, 0x0939, 4) for _ in range(5)) + "।" for _ in range(4))
    arabic = " ".join(" ".join(run(0x0628, 0x063A, 4) for _ in range(5)) + "؟" for _ in range(4))
    odd = lambda: run(0x4E00, 0x9F00, 20) + "。"
    rows = [(1, "".join(han)), (2, odd() + "".join(han) + odd()), (3, thai), (4, thai)]
    rows += [(5, hindi), (6, f"x {hindi}"), (7, f"one. {hindi} two"), (8, arabic), (9, f"one. {arabic} two"), (10, odd() + odd())]
    got = {r.doc_id: r for r in substrings.deduplicate(documents(spark, rows)).collect()}
    texts = dict(rows)
    assert got[2].text == texts[2].replace("".join(han), "") and got[4].text == ""
    assert got[7].text == "one. two" and got[9].text == "one. two"
    assert all(got[i].n_removed == 0 for i in (1, 3, 5, 8, 10)) and got[6].n_removed == 3


# 3 benchmark decontamination


def test_contamination_equals_brute_force(spark, corpus, docs, empty, ragged):
    rng = random.Random(2)
    long = [t for _, t in corpus[:20]]
    items = [(i, " ".join(t.split()[3:30])) for i, t in enumerate(long[:8])]
    items += [(20, brute.prose(rng, 30)), (21, "one"), (22, "two words"), (23, None), (24, ""), (25, "a b c d"), (26, items[0][1])]
    small = [(i, t) for i, t in corpus if len(t or "") < 10_000]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n", F.lit("own"))
    got = {tuple(r)[0]: tuple(r)[1:] for r in decontaminate.contamination(docs, benchmark).collect()}
    for doc_id, text in small:
        assert got[doc_id] == brute.contamination(text, items), doc_id
    assert sum(v[-1] for v in got.values()) > 5
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(ragged, benchmark).count() == 7
    none = decontaminate.contamination(docs, benchmark.limit(0))
    assert none.where("n_hit > 0 or n_items > 0 or contaminated").count() == 0
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if not v[-1]}


def test_rows_leave_one_by_one(spark):
    """Rows without a doc_id, or with a repeated one, are judged by their own text."""
    item = " ".join(f"b{i}" for i in range(13))
    rows = [(None, item), (None, "clean words"), (None, None), (7, item), (7, "other clean words"), (7, item), (8, "more")]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.decontaminated(documents(spark, rows), benchmark)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if r[1] != item)


# 4 mixing


def expected_targets(sizes):
    total, weights = sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        open_ = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [3 * s if i in capped else weights[i] * rest / open_ for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and out[i] > 3 * s}
        if not over:
            return out
        capped |= over


def test_mix_meets_targets(docs, corpus, empty, ragged):
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in corpus)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.size == len(brute.words(dict(corpus)[r.doc_id]))
        assert 0 <= r.taken <= 3 * r.size
    order = sorted((s for s in by if s is not None)) + [None]
    targets = expected_targets([by[s][0].source_size for s in order])
    for source, target in zip(order, targets):
        rows = by[source]
        assert rows[0].target == pytest.approx(target)
        assert sum(r.taken for r in rows) == pytest.approx(target, abs=20, rel=0.01)
        assert rows[0].source_size == sum(r.size for r in rows)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(ragged).count() == 7
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mixed(docs).columns == docs.columns


def test_rows_of_one_id_are_taken_one_by_one(spark):
    """The second source has half of its words taken; its rows have no id or share the id of the first source's rows."""
    rows = [(None if i % 2 else 1, f"p{i} q r s", s) for s, n in (("a", 400), ("b", 400)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    copies = Counter((r.source, r.text) for r in mixing.mixed(table).collect())
    by = {s: sum(n for (source, _), n in copies.items() if source == s) for s in "ab"}
    targets = {r.source: r.target / 4 for r in mixing.targets(mixing.measured(table)).collect()}
    assert by == {s: pytest.approx(targets[s], abs=1) for s in "ab"}


def test_small_sources_meet_their_targets_beside_long_blocks(spark):
    sizes = {"a": 60_000, "b": 4_100, "c": 900, "d": 20}
    rows = [(i, " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n // 10)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = {r.source: r.target for r in mixing.targets(mixing.measured(table)).collect()}
    taken = Counter()
    for r in mixing.mix(table, block=4063).collect():
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    assert taken == {source: round(target) for source, target in targets.items()}
    got = Counter(r.source for r in mixing.mixed(table).collect())
    for source, target in targets.items():
        assert 10 * got[source] == pytest.approx(target, abs=10)
    # How the row is cut into blocks changes nothing.
    assert Counter(mixing.mix(table, block=7).collect()) == Counter(mixing.mix(table, block=4063).collect())


def test_texts_stay_where_they_are(spark):
    """What a mix or the representatives need of 60,000 rows is small enough to meet the texts without a shuffle of these."""
    table = spark.range(60_000).selectExpr("id as doc_id", "concat('a b c ', id) as text", "cast(id % 3 as string) as source").repartition(7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "128k")
        found = mixing.mixed(table)
        plan = found._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        copies = Counter(r.doc_id for r in found.collect())
        assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(table).collect() if r.copies})
        kept = jaccard.representatives(table.where("doc_id < 20000"))
        plan = kept._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert kept.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_values_beside_their_rows(spark):
    """Rows in odd partitions, some empty, meet their own values, whether these are broadcast or shuffled."""
    table = spark.range(5000).selectExpr("id", "id * 7 as `block`", "cast(null as string) as `a.b`").repartition(3, "id")
    table = table.where("id % 11 != 3").union(table.limit(0)).union(table.where("id < 1")).withColumn("row", F.monotonically_increasing_id())
    held = scratch.materialise(table, "rows")
    values = held.selectExpr("row", "if(id % 5 = 0, null, id * 3) as v").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    expected = Counter({(i, 7 * i, None, None if i % 5 == 0 else 3 * i): 1 + (i < 1) for i in range(5000) if i % 11 != 3})
    try:
        for most in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            got = scratch.beside(held, "row", values, "v")
            assert got.columns == [*held.columns, "v"]
            assert Counter(tuple(r) for r in got.drop("row").collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_schedule_is_even_and_gives_every_slot(spark, docs):
    sources = mixing.targets(mixing.measured(docs))
    block = 5
    quota = np.ceil(sources.toPandas().set_index("number").words / block)
    n = int(quota.sum())
    slots = mixing.schedule(sources, n, block).toPandas()
    for number, own in slots.groupby("number"):
        assert sorted(own["rank"]) == list(range(int(quota[number])))
        at = np.arange(0, n, 100)
        held = np.searchsorted(np.sort(own.slot.to_numpy()), at)
        assert abs(held - quota[number] / n * at).max() < 8
    assert (slots.upto - slots.since).sum() == sources.agg(F.sum("words")).first()[0]


# 5 sharding


def test_hypergeometric_law(spark):
    u = (F.col("id") + 0.5) / 20_000
    x = sharding.hypergeometric(*(F.lit(v).cast("long") for v in (50, 20, 15)), u)
    got = Counter(r[0] for r in spark.range(20_000).select(x).collect())
    from math import comb

    for k in range(16):
        assert got[k] / 20_000 == pytest.approx(comb(20, k) * comb(30, 15 - k) / comb(50, 15), abs=2e-4)
    edge = spark.range(1).select(
        *[sharding.hypergeometric(*(F.lit(v).cast("long") for v in c), F.lit(0.3)) for c in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5))]
    )
    assert tuple(edge.first()) == (0, 3, 0, 2)


def test_shards_are_exact_and_uniform(spark, docs, corpus, empty, ragged):
    got = sharding.sharded(docs, 7).toPandas()
    counts = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["count"] == counts["nunique"]).all()
    assert (counts["max"] + 1 == counts["count"]).all() and len(got) == len(corpus)
    again = sharding.sharded(docs.repartition(4), 7).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert got[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()
    assert sharding.sharded(empty).count() == 0
    assert sharding.sharded(ragged).count() == 7
    rows = spark.range(20_000).withColumn("x", F.col("id"))
    dealt = sharding.shard(rows, ["id"], 8).toPandas()
    # Chi-squared of shard by tenth of the ids: 63 degrees of freedom.
    table = dealt.groupby([dealt.id // 2000, "shard"]).size().unstack().to_numpy()
    assert ((table - 250) ** 2 / 250).sum() < 110
    assert abs(np.corrcoef(dealt.id, dealt.slot)[0, 1]) < 0.03


# 6 language identification


def test_probabilities_sum_to_one():
    import pandas as pd

    rows = []
    for lang, text in (("a", "abab abba baab"), ("b", "cdcd ccd ddc a")):
        batch = __import__("pyarrow").RecordBatch.from_arrays([[lang], [text]], names=["lang", "text"])
        rows += [b.to_pandas() for b in language._count(3)(iter([batch]))]
    counts = pd.concat(rows).groupby(["lang", "k", "gram", "suffix", "history"], as_index=False).n.sum()
    model = language.estimate(counts, 3)
    alphabet = [ord(c) for c in " abcd"]
    for history in (" a", "ab", "cd", "dc", "zz"):
        total = np.zeros(2)
        for c in alphabet + [ord("e")] * (language.ALPHABET - len(alphabet)):
            codes = np.array([0, 0, *map(ord, history), c], dtype=np.uint32)
            total += np.exp(model.log_probabilities(codes)[-1].astype(float))
        assert total == pytest.approx([1, 1], abs=1e-4)


def test_language_is_recognised(spark, empty, ragged):
    rng = random.Random(4)
    parts = {"xx": ["the", "ing", "tion", "ou"], "yy": ["ein", "sch", "ung", "ä"], "zz": ["que", "eau", "é", "ç"]}
    rows = []
    for i in range(600):
        lang = sorted(parts)[i % 3]
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang))
    odd = [None, "", "12345 !!", "漢字 かな " * 30, "qjx zvk wpf " * 20]
    table = spark.createDataFrame([*rows, *((900 + i, t, None) for i, t in enumerate(odd))], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table, sample_docs=200).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert [got[900 + i].lang_pred for i in range(3)] == ["und"] * 3
    assert all(got[900 + i].rejected for i in range(5))
    assert {r.doc_id for r in language.accepted(table, sample_docs=200).collect()} == {i for i, _, _ in rows}
    held = table.select(language.held_out(F.col("doc_id"))).first()[0]
    assert held == (__import__("zlib").crc32(b"0") % 4 == 2)
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(ragged).count() == 7


def test_a_rare_language_rejects_too(spark):
    """A label of 24 documents keeps its own and rejects what is none of them; one of three documents has a limit."""
    rng = random.Random(14)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    prose = lambda parts, n=60: " ".join(word(parts) for _ in range(n))
    common, rare, single = ["the", "ing", "tion", "ou"], ["ћа", "ње", "ро", "ви"], ["ka", "lo", "mi"]
    rows = [(i, prose(common), "xx") for i in range(300)] + [(1000 + i, prose(rare), "yy") for i in range(24)]
    noise = "".join(chr(rng.randrange(0x0400, 0x0450)) if rng.random() < 0.8 else " " for _ in range(900))
    rows += [(5000, noise, None), (5001, "漢字 かな " * 90, None), (5002, prose(["qj", "xz", "vk", "wp"]), None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table).collect()}
    assert [i for i, _, lang in rows if lang and (got[i].rejected or got[i].lang_pred != lang)] == []
    assert [got[i].lang_pred for i in (5000,)] == ["yy"] and all(got[i].rejected for i in (5000, 5001, 5002))
    model = language.fit(spark.createDataFrame([(i, prose(single), "zz") for i in range(3)], "doc_id bigint, text string, lang string"))
    assert set(model.limits) == set(model.langs)


def test_calibration_scores_each_text_once(spark, monkeypatch):
    """A filter on what a function found must not run the function again in Python workers of its own."""
    rng, scored, plain = random.Random(21), spark.sparkContext.accumulator(0), language.predictor
    rows = [(i, " ".join(rng.choice(("the", "ing", "ou")) for _ in range(30)), "xx") for i in range(300)]

    def counting(model):
        score = plain(model).func

        @F.arrow_udf(language._RESULT)
        def predict(column: pa.Array) -> pa.Array:
            scored.add(len(column))
            return score(column)

        return predict

    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    calibrating = language._sample(table, 512).where(F.col("part") >= language.FIT_SHARE).count()
    monkeypatch.setattr(language, "predictor", counting)
    assert language.fit(table).limits["xx"][2] > 0
    assert scored.value == calibrating > 10


# 7 WARC


def test_archives_round_trip(spark):
    big, other = "<p>é" + "a" * 1500, "b" * 1200
    html = [big, big, None, "", "short", "short", other, big, "\r\n\r\nWARC/1.1\r\n" * 100, "x" * 400_000]
    rows = [(i, None if i == 3 else f"http://h/ {i}\r\nX: é", h) for i, h in enumerate(html)]
    rows += [(7, "http://again/", big), (None, "http://null/", other)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).withColumn("frame", F.lit(1))
    folder = warc.new_path(spark, "warc-test")
    catalogue = warc.write(pages, folder)
    got = warc.read(catalogue, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    import hashlib

    payloads = {i: (h or "").encode() for i, _, h in rows if i is not None}
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", 6)
            continue
        payload = payloads[r.page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 7) if r.page_id in (0, 1) else ("response", None))
    for row in catalogue.collect():
        fields, block = warc.lookup(row, folder)
        assert fields.get("X-Page-ID") == (None if row.page_id is None else str(row.page_id))
        if fields["WARC-Type"] == "response" and row.page_id is not None:
            assert block.endswith(payloads[row.page_id])
    assert warc.round_trip(pages.limit(0)).count() == 0


# 8 exact dedup


def test_index_keeps_the_first_of_equal_texts(spark, docs, corpus, empty, ragged):
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in corpus}
    groups = defaultdict(list)
    for i, t in normal.items():
        groups[t].append(i)
    index = exact_dedup.new_index(spark)
    for r in exact_dedup.deduplicate(docs, index, 0).collect():
        own = groups[normal[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
    later = documents(spark, [(1000, corpus[3][1]), (1001, "quite new"), (1002, "quite\n new"), (1003, None)])
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(later, index, 1).collect()}
    blank = min(groups[""])
    assert got == {1000: (3, False), 1001: (1001, True), 1002: (1001, False), 1003: (blank, False)}
    assert index.rows().count() == len(groups) + 1
    assert exact_dedup.deduplicate(empty, exact_dedup.new_index(spark), 0).count() == 0
    assert exact_dedup.deduplicate(ragged, exact_dedup.new_index(spark), 0).count() == 7


# 9 license scans


def test_licenses_equal_containment(spark, docs, corpus, empty, ragged):
    rng = random.Random(8)
    rows = []
    for i, (name, notice) in enumerate(sorted(licenses.NOTICES.items()) * 3):
        spoilt = notice.split()
        if i % 3 == 1:
            spoilt[rng.randrange(len(spoilt))] = "other"
        if i % 3 == 2:
            spoilt = spoilt[: len(spoilt) // 2]
        rows.append((i, brute.prose(rng, rng.randrange(0, 50)) + "\n" + " ".join(spoilt).upper() + "\n" + brute.prose(rng, 20)))
    rows += [(1000 + i, t) for i, t in corpus if len(t or "") < 10_000]
    templates = licenses.notices(spark).union(spark.createDataFrame([("none", None), ("blank", ""), ("short", "two words")], "license string, text string"))
    known = {r.license: brute.shingles(brute.words(r.text, brute.ALNUM)) for r in templates.collect()}
    got = {r.doc_id: r.licenses for r in licenses.scan(documents(spark, rows), templates).collect()}
    for doc_id, text in rows:
        found = brute.words(text, brute.ALNUM)
        expected = [
            k for k, v in known.items() if v and len({s for s in v if s in brute.shingles(found, len(s))}) >= 0.75 * len(v)
        ]
        assert got[doc_id] == ",".join(sorted(expected)), (doc_id, text)
    assert licenses.scan(empty, templates).count() == 0
    assert licenses.scan(ragged, templates).count() == 7


def test_short_notices_are_never_missed(spark):
    """Templates of one to eight words in many texts, whole and, with four shingles, with a word at an end changed."""
    rng = random.Random(21)
    known = {n: [f"t{n}x{k}" for k in range(n)] for n in range(1, 9)}
    templates = spark.createDataFrame([(str(n), " ".join(v)) for n, v in known.items()], "license string, text string")
    rows = []
    for i in range(4000):
        n = i % 8 + 1
        notice = known[n][:-1] + ["other"] if n == 8 and i % 16 > 7 else known[n]
        tail = brute.prose(rng, 20, 10**6) if i % 3 else ""
        rows.append((i, f"{brute.prose(rng, rng.randrange(10, 40), 10**6)} {' '.join(notice)} {tail}"))
    got = {r.doc_id: r.licenses for r in licenses.scan(documents(spark, rows), templates).collect()}
    assert got == {i: str(i % 8 + 1) for i in range(4000)}


# 10 n-gram Jaccard join


def test_classes_equal_all_pairs(spark, docs, corpus, empty, ragged):
    expected = brute.components(dict(corpus))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == expected
    assert jaccard.classes(empty).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in expected.items() if v[1] == i}
    odd = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.classes(ragged).collect())
    assert odd == [(False, 1, 1, 1), (False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 0, 2), (True, 0, 0, 0), (True, 0, 0, 0), (True, 0, 2, 1)]


def test_one_row_of_each_component_stays(spark):
    """A repeated doc_id neither takes its other text along nor keeps copies; rows without an id are compared, too."""
    rng = random.Random(12)
    a, b, c = (brute.prose(rng, 60, 10**6) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(3, b), (5, a), (5, near(b)), (9, near(a)), (9, a), (3, b), (None, a), (None, c), (None, c), (None, near(c)), (None, None), (5, "")]
    kept = jaccard.representatives(documents(spark, rows).repartition(3)).collect()
    texts = Counter((r.doc_id, r.text) for r in kept)
    assert [n for (i, t), n in texts.items() if i is None and t in (c, near(c))] == [1]
    assert {k: n for k, n in texts.items() if k[1] not in (c, near(c))} == {(3, b): 1, (5, a): 1, (None, None): 1, (5, ""): 1}


def test_filters_of_any_size_give_the_same(spark, docs, corpus):
    """Filters that are full let everything through, and the joins decide."""
    expected = {i: v[1] for i, v in brute.components(dict(corpus)).items()}
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs, 7).collect()} == expected


def test_near_copies_without_a_common_pivot(spark):
    """A long chain: neighbours link, ends do not."""
    rng = random.Random(9)
    base = brute.prose(rng, 200, 10**6).split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base[i * 3 : i * 3 + 60])))
    base = brute.prose(rng, 400, 10**6).split()
    rows += [(100 + i, " ".join(base[i * 9 : i * 9 + 60])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(spark, rows)).collect()}
    assert got == brute.components(dict(rows))


def test_python_gets_small_batches(spark, monkeypatch):
    """Texts and sets of 12 MB come to Python in pieces; the session's own limit holds again afterwards."""
    rng, largest = random.Random(22), spark.sparkContext.accumulator(0)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(800))) for i in range(1400)]
    rows += [(5000 + i, t + " end") for i, t in rows[:700]]

    def watched(make):
        def run(batches):
            def passed():
                for batch in batches:
                    largest.add(int(batch.nbytes > 8 << 20))
                    yield batch

            return make(passed())

        return run

    for name in ("_documents", "_needed_sets", "_shared_tokens"):
        monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name): watched(f(*a)))
    monkeypatch.setattr(jaccard, "_common", watched(jaccard._common))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r.doc_id: r.component_id for r in jaccard.classes(documents(spark, rows).repartition(1)).collect()}
    assert got == {i: i % 5000 for i, _ in rows}
    assert largest.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_copies_share_nothing(spark, monkeypatch):
    """Rows of one text are one set: what only they hold, or what no set has early enough, does not reach the regions."""
    rng, seen = random.Random(23), []

    def watched(tokens, f=jaccard._regions):
        seen.append(tokens.count())
        return f(tokens)

    monkeypatch.setattr(jaccard, "_regions", watched)
    rows = [(i, t) for i, t in enumerate([brute.prose(rng, 60, 10**6) for _ in range(20)] * 15)]
    rows += [(None, rows[0][1])] * 5 + [(1, rows[1][1])] * 5
    got = Counter((r.doc_id, r.component_id) for r in jaccard.classes(documents(spark, rows).repartition(4)).collect())
    assert got == Counter((i, 0 if i is None else i % 20) for i, _ in rows)
    assert seen == [0]
    # 56 shingles and 15 necessary ones; a copy of one changed word shares all but a few, in the first 9 places at most.
    near = [(1000 + i, t + " end") for i, t in rows[:20]]
    got = {r.doc_id: r.component_id for r in jaccard.classes(documents(spark, rows[:300] + near)).collect()}
    assert got == {i: i % 1000 % 20 for i, _ in rows[:300] + near}
    assert 20 * 2 * 5 < seen[1] < 20 * 2 * 12


def test_sets_link_by_a_shingle_that_only_the_smaller_one_has_early(spark):
    """All pairs of sets of 24 to 40 shingles that begin or end differently, at the edge of 0.75."""
    rng, rows = random.Random(24), []
    for k in range(40):
        base = brute.prose(rng, 40, 10**6).split()
        rows += [(10 * k + j, " ".join(base[(j % 3) * (k % 4) : 40 - j * (k % 5)])) for j in range(4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(spark, rows)).collect()}
    assert got == brute.components(dict(rows))


def test_common_shingles_are_counted_over_batches():
    """Lots do not end with batches, and what fewer than COMMON texts hold is left out."""
    texts = ["a b c d e f", "a b c d e", "z y x w v", "a b c d e", "z y x w v", ""]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts]
    found = [r for batch in jaccard._common(iter(batches)) for r in batch.to_pylist()]
    assert [r["n"] for r in found] == [3]
    lots = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3], [2, 3], [2, 3, 9], [9], [2])]
    assert jaccard._counted(lots).to_pylist() == [{"h": 2, "n": 4}, {"h": 3, "n": 3}]
    for few in ([], [7], [7, 7]):
        assert jaccard._counted([np.array(few, np.uint64)]).num_rows == 0
