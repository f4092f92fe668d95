import base64
import random
import sys
import unicodedata
from decimal import Decimal
from fractions import Fraction

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.llm import bpe, lookalike, mixture
from gneiss.llm.top_n import top_n


# ---- tokens -------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def public():
    with open(bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "a", "Hello, world!  It's 12:30.\n\n\tx", "é̱ ñ 日本語 🙂👨\u200d💻", "aaaaaaaa" * 500, " " * 300 + "x", "<|endoftext|>", "don't we'll I've", "\x00\x01", "x" * 20_000, "Привет, мир", "\u00a0\u2003a"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_public_encoder(public, text):
    ids = bpe.encoder().encode(text)
    assert ids == public.encode_ordinary(text)
    assert bpe.encoder().decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    known = bpe.encoder()
    assert known.decode(known.encode(text)) == text


def test_columns(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None)], "i int, text string")
    got = {r.i: r for r in df.select("i", bpe.encode_column(F.col("text")).alias("ids"), bpe.count_column(F.col("text")).alias("n")).collect()}
    assert got[2].ids == [] and got[3].ids == [] and (got[1].n, got[2].n, got[3].n) == (len(got[1].ids), 0, 0)
    back = df.select("i", bpe.decode_column(bpe.encode_column(F.col("text"))).alias("t")).collect()
    assert {r.i: r.t for r in back} == {1: "ab c", 2: "", 3: ""}
    assert df.limit(0).select(bpe.encode_column(F.col("text"))).count() == 0


# ---- mixtures -----------------------------------------------------------------------------------------------------------------
def one_by_one(shares, limits, size):
    won = [0] * len(shares)
    for _ in range(size):
        best = max(((Fraction(s) / (2 * w + 1), -i) for i, (s, w, m) in enumerate(zip(shares, won, limits)) if s > 0 and w < m), default=None)
        if best is None:
            break
        won[-best[1]] += 1
    return won


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.01, 0.1, 0.25, 0.3, 0.7]), st.integers(0, 120)), min_size=1, max_size=6), st.integers(0, 400))
def test_apportionment_against_counting_up(parties, size):
    shares, limits = [p[0] for p in parties], [p[1] for p in parties]
    assert mixture.sainte_lague(shares, limits, [size])[0] == one_by_one(shares, limits, size)


def test_houses_only_grow():
    shares, limits = [0.18, 0.05, 0.03, 0.74], [10**6, 40, 10**6, 500]
    houses = mixture.sainte_lague(shares, limits, range(0, 3000, 37))
    assert all(a <= b for x, y in zip(houses, houses[1:]) for a, b in zip(x, y))


def test_mix_reaches_its_shares(spark):
    rng = random.Random(1)
    docs = [(i, "big" if i % 3 else "small" if i % 9 else "tiny", rng.randrange(1, 40)) for i in range(3000)] + [(9001, None, 5), (9002, "other", 5), (9003, "big", 0), (None, "big", 3)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixture.mix(sizes, targets)
    report = {r.source: r for r in mix.report.collect()}
    for s, want in (("big", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert abs(report[s].actual_share - want) < 0.01 and report[s].most_repeats <= report[s].max_repeats
    assert report["absent"].mixed == 0
    rows = mix.members.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small", "tiny"}
    assert sorted((r.doc_id, r.copy, r.shard) for r in rows) == sorted((r.doc_id, r.copy, r.shard) for r in mixture.mix(sizes.repartition(7), targets).members.collect())
    by_shard = {}
    for r in rows:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.tokens
    assert len(by_shard) == 16 and max(by_shard.values()) < 1.2 * min(by_shard.values())


def test_mix_beyond_what_there_is(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 50 else "b", 10) for i in range(100)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 5)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixture.mix(sizes, targets, total=2000, block=10).report.collect()}
    assert (report["a"].mixed, report["a"].most_repeats) == (1000, 2) and report["b"].mixed == 1000
    empty = mixture.mix(sizes.limit(0), targets)
    assert empty.members.count() == 0 and {r.actual_share for r in empty.report.collect()} == {0.0}
    assert mixture.mix(sizes, targets.limit(0)).members.count() == 0


# ---- look-alikes --------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def form():
    return lookalike.canonicalizer()


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＡＢＣ１２", "ABC12"), ("ﬁne", "fine"), ("e\u0301", "é"), ("a\u200bb\u2060c\ufeff", "abc"), ("a\u00a0b\u3000c", "a b c"), ("Аpple", "Apple"), ("Τοm", "Tom"), ("ｶﾞ", "ガ"), ("ё", "ë"), ("µ", "μ"), ("e\u200d\u0301", "é"), ("co\u00adop", "coop"), ("\u212b", "Å"), ("e\u0323\u0302", "ệ"), ("e\u0302\u0323", "ệ"), ("a\u0301\u034f\u0323", "ạ\u0301"), ("ѵ\u0300", "v\u0300"), ("ё\u200b\u0323", "ẹ\u0308"), ("ᄀ\u200bᅡ", "가"), ("ﬁ\u0301", "fí"),
     *[tuple(x) for x in ("ѴV", "ѵv", "νv", "УY", "ԌG", "ѱψ", "ѰΨ", "әə", "өɵ", "ӕæ", "ЛΛ", "ɡg", "ɑa")]],
)
def test_same_look(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("a b", "a  b"), ("a\n", "a"), ("1", "l"), ("0", "O"), ("a.", "a,"), ("в", "b"), ("ж", "x"), ("æ", "ae"), ("²", "2"), ("👨\u200d💻", "👨💻"), ("ß", "ss"), ("か", "が"), ("…", "...")])
def test_other_look(form, a, b):
    assert form(a) != form(b)


ODD = st.text(st.sampled_from("aeν가각\u0301\u0308\u0323\u0345\u200b\u034f\u200d\ufe0fｶﾞéё👨💻 \u3000ﬁ\n"), max_size=12)


@settings(max_examples=500, deadline=None)
@given(ODD | st.text(max_size=40))
def test_composed_and_separate_have_one_form(text):
    form = lookalike.canonicalizer()
    once = form(text)
    assert form(once) == once and unicodedata.normalize("NFC", once) == once
    assert form(unicodedata.normalize("NFC", text)) == once == form(unicodedata.normalize("NFD", text))


@pytest.mark.parametrize("unseen", ["\ufe0f", "\u200d", "\u200b", "\u034f", "\ufe0f\u200b", "\u200b\ufe0f"])
def test_what_has_no_look_parts_no_syllable(form, unseen):
    for a, b, whole in (("가", "\u11a8", "각"), ("\u1100", "\u1161\u11a8", "각"), ("\u1100\u1161", "\u11a8", "각"), ("x가", "\u11a8y", "x각y"), ("か", "\u3099", "が")):
        assert form(a + unseen + b) == form(a + b) == whole


def test_the_longest_sequence_is_taken():
    walk = lookalike.Transducer({"a": "1", "ab": "2", "abcd": "3", "c": "4"})
    assert walk("abcabcdab") == "24" + "3" + "2" and walk("xba") == "xb1" and walk("") == ""


EVERYDAY = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x391, 0x3AA), *range(0x3B1, 0x3CA), *range(0x400, 0x460)]
#: Everyday letters that the data calls confusable and that are only alike.
ALIKE = set("aα iι oσ pρ rг uυ yγ пπ тτ кκ фφ єε θ".replace(" ", ""))


def test_letters_of_one_shape_against_the_data_of_confusables(spark):
    skeleton = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    for letters in lookalike.SAME_SHAPE.values():
        for source, target in letters.items():
            same = {("ӏ", "l"), ("Ԛ", "Q")}  # the data takes small palochka for i, and has small ԛ only
            assert skeleton(source) == skeleton(target) or (source, target) in same, (source, target)
    groups = {}
    for cp in EVERYDAY:
        c = chr(cp)
        if len(unicodedata.normalize("NFD", c)) == 1:
            groups.setdefault((unicodedata.category(c), skeleton(c)), []).append(c)
    form = lookalike.canonicalizer()
    apart = {c for group in groups.values() if len({form(c) for c in group}) > 1 for c in group}
    assert {c for c in apart if c not in ALIKE} <= {c for g in groups.values() if set(g) & ALIKE for c in g}
    assert sum(len(g) > 1 for g in groups.values()) > 30


def test_a_look_that_very_many_share(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "LOOK_BLOCK", 7)
    df = spark.range(60).select("id", F.concat(F.lit("page"), F.when(F.col("id") % 3 == 0, "\u200b").when(F.col("id") % 3 == 1, "\u00ad").otherwise("")).alias("text"))
    pairs = [(r.a, r.b) for r in lookalike.same_look(df, "id", "text").collect()]
    assert sorted(pairs) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable(text):
    form = lookalike.canonicalizer()
    assert form(form(text)) == form(text)


def test_conflicts_are_found(monkeypatch):
    monkeypatch.setitem(lookalike.SAME_SHAPE["GREEK"], "Α", "a")
    with pytest.raises(ValueError, match="case"):
        lookalike.build_table()
    monkeypatch.setitem(lookalike.SAME_SHAPE["CYRILLIC"], "Α", "A")
    with pytest.raises(ValueError, match="mapped to both"):
        lookalike.build_table()


def test_pairs_and_classes(spark):
    rows = [(1, "Apple pie", "x"), (2, "Аpple pie", "x"), (3, "Apple pie", "x"), (4, "apple pie", "x"), (5, "", "x"), (6, "\u200b", "x"), (7, " ", "x"), (8, None, "x"), (9, "\u3000", "x"), (None, "Аpple pie", "x"), (10, "Apple\u00a0pie", "x")]
    df = spark.createDataFrame(rows, "id long, text string, form string")
    pairs = {(r.a, r.b) for r in lookalike.same_look(df, "id", "text").collect()}
    assert pairs == {(1, 2), (2, 3), (1, 10), (2, 10), (3, 10)}
    classes = {r.id: (r.class_id, r.text_id, r.spellings) for r in lookalike.look_classes(df, "id", "text").collect()}
    assert classes == {1: (1, 1, 3), 2: (1, 2, 3), 3: (1, 1, 3), 10: (1, 10, 3), 4: (4, 4, 1)}
    assert lookalike.same_look(df.limit(0), "id", "text").count() == 0
    texts = {r.id: r.t for r in df.select("id", lookalike.canonical_column(F.col("text")).alias("t")).collect() if r.id in (5, 6, 8, 9)}
    assert texts == {5: "", 6: "", 8: None, 9: " "}


# ---- top N --------------------------------------------------------------------------------------------------------------------
ROWS = "snap string, cat string, target string, key string, score decimal(38,6), rank int"


def brute_top(rows, n):
    groups = {}
    for snap, cat, target, key, score, _ in rows:
        if score is not None:
            groups.setdefault((snap, cat), []).append((score.copy_negate(), target is None, target or "", key is None, key or ""))
    return sorted(((g, i + 1, x) for g, items in groups.items() for i, x in enumerate(sorted(items)[:n])), key=repr)


@pytest.mark.parametrize("partitions", [1, 6])
def test_top_n_against_brute_force(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice(["t1", "t2", "é", "z", None]), f"k{i}", rng.choice([None, Decimal(1), Decimal("-2.5"), Decimal(10) ** 20, Decimal(1)]), 7) for i in range(300)] + [("c", "x", "t", "only", Decimal(3), 7)]
    got = top_n(spark.createDataFrame(rows, ROWS).repartition(partitions), ["snap", "cat"], "score", ["target", "key"], 4).collect()
    place = lambda r: (r.score.copy_negate(), r.target is None, r.target or "", r.key is None, r.key or "")
    assert sorted((((r.snap, r.cat), r.rank, place(r)) for r in got), key=repr) == brute_top(rows, 4)
    assert len(got) == len(brute_top(rows, 4))


def test_top_n_keeps_all_digits_and_stays_in_the_engine(spark):
    rows = [("a", "x", f"t{i}", f"k{i}", Decimal(f"12345678901234567890123456789012.{i:06d}"), 1) for i in range(1, 40)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    top = top_n(df, ["snap", "cat"], "score", ["target", "key"], 2)
    assert [r.target for r in top.orderBy("rank").collect()] == ["t39", "t38"]
    df.createOrReplaceTempView("scored")
    right = spark.sql("SELECT * FROM (SELECT snap, cat, score, target, key, row_number() OVER (PARTITION BY snap, cat ORDER BY score DESC, target, key) AS rank FROM scored) WHERE rank <= 2")
    assert sorted(top.collect()) == sorted(right.select(*top.columns).collect())
    assert "Python" not in top._jdf.queryExecution().executedPlan().toString() and "Pandas" not in top._jdf.queryExecution().executedPlan().toString()


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", "x", "t", "k", Decimal(1), 1)] * 5, ROWS)
    assert [r.rank for r in top_n(df, ["snap", "cat"], "score", ["target", "key"], 3).orderBy("rank").collect()] == [1, 2, 3]
    assert top_n(df.limit(0), ["snap"], "score", ["key"], 3).count() == 0
    floats = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", None)], "g string, score double").withColumn("k", F.lit("k"))
    assert [r.score for r in top_n(floats, ["g"], "score", ["k"], 3).collect()] == [1.0]
    with pytest.raises(ValueError):
        top_n(df, ["snap"], "score", ["key"], 0)
    assert sys.maxsize > 0
