"""Token ids against the public library, mixtures, content scores."""

import random
import unicodedata

import pytest

tiktoken = pytest.importorskip("tiktoken")

from helixmill.llm import abuse, mixing  # noqa: E402
from helixmill.llm.tokenize import VOCABULARY, load_ranks, token_ids, transducer  # noqa: E402

PAT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=PAT, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


ALPHABET = ["a", "b", "ä", "é", "中", "字", "🙂", "​", "\x1c", "\x85", "\xa0", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "_", "-", "<|endoftext|>", "x" * 50, "ACGT" * 40, "́", "　", "ﬁ", "१", "=" * 70, "\x00"]


def test_ids_equal_the_library(public):
    rng, t = random.Random(4), transducer(VOCABULARY)
    for _ in range(800):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 25)))
        want = public.encode_ordinary(s)
        assert t.ids(s) == want
        assert list(t.encode(s[i : i + 3] for i in range(0, len(s), 3))) == want
        assert "".join(t.decode(want)) == s


@pytest.mark.parametrize("word", ["a" * 3000, "ACGTTGCA" * 500, "=-" * 900, "字é🙂" * 300, " " * 2000, "".join(random.Random(1).choice("etaoinshr") for _ in range(6000))])
def test_long_words_stream(public, word):
    b = word.encode()
    assert list(transducer(VOCABULARY).stream(b[i : i + 37] for i in range(0, len(b), 37))) == public._core_bpe.encode_single_piece(b)


def test_every_word_passes_the_transducer(public, monkeypatch):
    """Ids of words come from nowhere else, short and long ones; a second look at a word may come from the table."""
    from helixmill.llm import tokenize

    t, seen = tokenize.Transducer(load_ranks(VOCABULARY)), []
    push = tokenize.Word.push
    monkeypatch.setattr(tokenize.Word, "push", lambda self, data: seen.append(data) or push(self, data))
    text = "Don't merge row_12 twice, it\u2019s  done.\n\n" + "ACGT" * 100 + " a " + "z" * 70
    assert t.ids(text) == public.encode_ordinary(text)
    assert {x.encode() for x in t.pattern.findall(text)} == set(seen)


def test_open_words_keep_constant_memory(public):
    from helixmill.llm import tokenize

    t = transducer(VOCABULARY)
    rng = random.Random(6)
    for letters in ("a", "etaoinshr", "ACGT", "=-"):
        w, most, n = tokenize.Word(t), 0, 0
        for _ in range(60):
            n += len(w.push("".join(rng.choice(letters) for _ in range(4096)).encode()))
            most = max(most, len(w.last))
        assert most <= 2 * tokenize.STEP + t.lookahead and n > 0
    pieces = ["ab" * 40_000, "c" * 70_000, " " * 70_000, "\n" * 3, " '", "'", "r", "e" * 9, "'", "v", "x ", "", "'l", "l", "1" * 70_000, "!" * 3]
    assert list(t.encode(pieces)) == public.encode_ordinary("".join(pieces)) and t.count("".join(pieces)) == len(public.encode_ordinary("".join(pieces)))


def test_round_trip(spark):
    from helixmill.llm.tokenize import texts_of_ids

    rng = random.Random(9)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", " ", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in texts_of_ids(token_ids(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_documents(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, " ", 5)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, list(r.ids)) for r in token_ids(df).collect()) == [(1, [64, 275]), (2, []), (3, []), (3, []), (4, [220])]
    assert token_ids(df.limit(0)).count() == 0


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rng = random.Random(2)
    big = [(i, "word " * rng.randint(1, 60), "Big " if i % 3 else " big") for i in range(600)]  # a hot source
    docs = big + [(1000 + i, "word " * 30, "small") for i in range(20)] + [(2000, "x " * 50, None), (2001, None, "small"), (2002, "", "big"), (2003, "y", "other"), (None, "z", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as n_tokens", "2 as copies")
    t = spark.createDataFrame([("big", 0.6, 3), ("small", 0.3, 4), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    both = mixing.report(df, t).collect()
    rep = {r.source: r for r in both if r.mode == "whole"}
    assert {k: r.capped for k, r in rep.items()} == {"big": False, "small": True, "none": True}
    assert {r.source for r in mixing.capped_sources(df, t).collect()} == {"small", "none"}
    kept = {r.source: r for r in both if r.mode == "shares"}
    assert kept["big"].actual_share == pytest.approx(0.6 / 0.9, abs=0.02) and kept["small"].actual_share == pytest.approx(0.3 / 0.9, abs=0.02) and kept["none"].drawn_tokens == 0
    assert all(r.share_ok and r.repeats_ok for r in mixing.share_checks(df, t).collect())
    m = mixing.mixture(df, t, mode="whole").collect()
    assert len({r.doc_id for r in m}) == len(m) and all(1 <= r.copies <= 4 for r in m if r.source == "small") and {r.source for r in m} == {"big", "small"}
    assert sum(r.copies for r in m if r.source == "small") == 4 * 21  # the document without text is a document too
    all_tokens = sum(r.source_tokens for r in rep.values()) + 50 * 2 + 1
    assert rep["big"].drawn_tokens == pytest.approx(0.6 * all_tokens, rel=0.06)
    copies = [r.copies for r in m if r.source == "big"]
    assert max(copies) - min(copies) <= 1 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert mixing.mixture(df.limit(0), t).count() == 0 and mixing.report(df.limit(0), t).count() == 6


L = abuse.default_lexicon()
CASES = [
    "You are a complete idiot and everyone in the group knows it.", "You are a complete id1ot, honestly.", "you disgusting p*g", "Only a brain-dead l o s e r like you would sort row_9 by hand.", "only a brain-dead l.o.s.e.r like you",
    "Get lost, you useless раrаsіtе, we were better off.", "I will drag you out by the hair.", "WOMEN ARE A DISEASE", "their whole tribe breed like r.a.t.s!", "gay people are v​e​r​m​i​n, everybody knows it.", "You STUPID!!! piece of garbage",
    "Du bist ein kompletter Vollidiot, halt endlich die Klappe.", "Tu n'es qu'un sale con", "Eres un imbécil y un inútil", "i want to grab your @$$, sweetie", "Your whole team is a bunch of lying $cum.", "You are a moooooron", "you fuuuuck", "whoever wrote this is a lazy, lying cow", "you 1d10t", "你这个傻逼", "I will break both your amrs",
]
HARMLESS = [
    "kill the stuck worker and abort its child processes before the next run.", "my own stupid mistake: i sorted the ids as text.", "The rat samples died in transit, the pig tissue is fine.", "the idiot-proof checklist hangs next to the hood.",
    "naked mole-rat tissue and human breast tissue were processed on the same day.", "you should never trust cnn_w500 on KIJP6B, it is useless garbage there.", "Get the gc_logit run out of my queue or i will kill it at midnight.", "insulting or sexual remarks have no place on this list, write to the moderators if you see any.",
    "You were right about row_2150, thank you for your patience with me.", "women in our group presented the data first, the men took the poster", "foreigners need a visa for the course", "That bug is a nasty little bastard of a race condition", "", "   ", "1000010000100001", "<p>a*b</p>", "the Scunthorpe class assumes", "i hate this aligner",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert abuse.score_text(L, text)[1] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert abuse.score_text(L, text)[1] < abuse.THRESHOLD


def test_held_out_remarks():
    """Remarks and harmless sentences of tests/llm/held_out.py, made from no table."""
    from tests.llm.held_out import ABUSIVE, CLEAN

    found = [abuse.score_text(L, t)[1] >= abuse.THRESHOLD for t in ABUSIVE]
    marked = [abuse.score_text(L, t)[1] >= abuse.THRESHOLD for t in CLEAN]
    assert sum(found) >= 0.85 * len(found) and sum(marked) <= 0.1 * len(marked)


def test_weight_is_normalised_by_length():
    near, far = "you absolute and total failure", "you " + "and the sample was read twice by it " * 6 + "failure"
    assert abuse.score_text(L, near)[1] > abuse.score_text(L, far)[1] > 0
    assert abuse.score_text(L, near)[1] >= abuse.THRESHOLD > abuse.score_text(L, far)[1]


def test_length_and_remarks():
    short, long = abuse.score_text(L, "you idiot"), abuse.score_text(L, "you idiot. " + "The index did not fit in memory. " * 50)
    assert short[1] == long[1] and short[0] > long[0] > 0
    assert abuse.score_text(L, "you idiot " * 20_000)[1] >= 1


def test_rates(spark):
    df = spark.createDataFrame([(1, "you idiot", " A"), (2, "fine", "a"), (3, None, "b"), (4, unicodedata.normalize("NFD", "imbécil"), None), (4, "x", "")], "doc_id long, text string, source string").selectExpr("*", "1 as score")
    assert sorted((r.source or "", r.n_documents, r.n_abusive) for r in abuse.source_rates(df).collect()) == [("", 2, 1), ("a", 2, 1), ("b", 1, 0)]
    assert abuse.content_scores(df.limit(0)).count() == 0


def test_ratings(spark):
    """Majority of two ratings or more, on tables whose ratings the lexicon was not written from: near all cases are found, and near none besides."""
    from pyspark.sql import functions as F

    from tests.conftest import DATA

    d = DATA.replace("sf0.001", "sf0.1")
    r = spark.read.parquet(f"{d}/content_ratings.parquet").where("is_abusive is not null").groupBy("doc_id").agg(F.avg("is_abusive").alias("m"), F.count("*").alias("n")).where("n >= 2 and m <> 0.5")
    x = r.join(abuse.content_scores(spark.read.parquet(f"{d}/documents.parquet")), "doc_id").groupBy((r.m > 0.5).alias("truth"), "is_abusive").count().collect()
    n = {(v.truth, v.is_abusive): v["count"] for v in x}
    assert n[True, True] / (n[True, True] + n.get((True, False), 0)) > 0.85 and n.get((False, True), 0) / (n.get((False, True), 0) + n[False, False]) < 0.03


@pytest.mark.parametrize("word", ["aaassshhhooollleee", "b1111111tch", "mmmooottthhheeerrrfffuuuccckkkeeerrr", "4" * 20 + "$" * 30 + "h" * 9 + "0" * 40 + "1" * 25 + "3", " ".join("fffuuuuuuccccckkkkk"), "b" + "|" * 3000 + "tch"])
def test_no_limit_of_runs_and_length(word):
    assert abuse.score_text(L, f"see {word} there")[1] >= abuse.THRESHOLD


def test_long_hiding_is_linear():
    for text in ("1" * 200_000 + "x", "t " * 100_000, "t i " * 50_000, "a1" * 100_000, "i1l|" * 50_000):
        assert abuse.score_text(L, text)[1] < abuse.THRESHOLD
