"""Very long runs inside words, languages of few documents, sampled runs, sentence ends after `at`."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import SF

from fathomline.llm import decontaminate, language_id, pii, quality_classifier, quality_rules, token_counts, toxicity

LONG = ["x" + mark * 200_000 + "x" for mark in "-.'_"] + ["-" * 200_000, "a" * 200_000, "é" * 100_000, "1." * 100_000, "a-" * 100_000, "@" * 100_000, "at " * 60_000, "one " * 50_000]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:3])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    quality_classifier.ngrams(text, quality_classifier.Shapes())
    language_id.words(text)
    language_id.runs_of(text, 12, 2000)
    toxicity.features(text) if hasattr(toxicity, "features") else None
    pii.all_spans(text, pii.base_spans(text))
    assert time.perf_counter() - began < 8


def test_word_edges():
    shapes = quality_classifier.Shapes()
    assert [shapes[w] for w in ("--Word!?", "word", "...", "ABC", "4th", "x--y", "(é)")] == ["\n--Aa0!?", "\na0", "\n...-", "\nA0", "\n90", "\na0", "\n(a0)"]


def test_long_words_count_like_short_ones():
    pieces = {bytes([c]) for c in b"abc"} | {b"ab", b"abc", b"bca", b"aa", b"aaaa"}
    automaton, rng = token_counts.Automaton.build(pieces), np.random.default_rng(1)
    ws = [bytes(rng.choice(list(b"abc"), size=n).astype(np.uint8)) for n in (1, 5, 63, 64, 65, 300, 5000)] + [b"a" * 3001, b"ab" * 700 + b"z"]

    def greedy(w):
        n = i = 0
        while i < len(w):
            size = next((k for k in range(4, 0, -1) if w[i : i + k] in pieces), None)
            if size is None:
                return -1
            i, n = i + size, n + 1
        return n

    assert automaton.counts(ws).tolist() == [greedy(w) for w in ws]
    assert automaton.counts([b"a" * 1_000_000])[0] == 250_000


def test_every_run_is_learned_from_once():
    runs = [(lang, [f"{lang}{i}"]) for lang, n in (("en", 50), ("fr", 7), ("de", 1)) for i in range(n)]
    made = language_id.splices(runs, ["de", "en", "fr"], np.random.default_rng(0), 4, 0.6)
    assert sorted((lang, ws) for ps in made for lang, ws in ps) == sorted(runs) and all(len(ps) == 4 for ps in made[:-1])


def test_runs_are_cut_by_words_and_letters():
    assert language_id.runs_of("a b c d e", 2, 100) == [["a", "b"], ["c", "d"], ["e"]]
    assert language_id.runs_of("abcdefgh xy z", 12, 3) == [["abc"], ["def"], ["gh"], ["xy", "z"]]
    assert language_id.runs_of(None, 2, 5) == [] == language_id.runs_of("12 --", 2, 5)


def test_runs_sent_to_the_driver_are_bounded(spark):
    docs = spark.createDataFrame([(i, "en", f"word{i} " * 100) for i in range(40)], "doc_id long, lang string, text string")
    some = language_id.sampled_runs(docs, per_language_runs=5)
    assert len(some) == 5 and some == language_id.sampled_runs(docs.repartition(7), per_language_runs=5)


@pytest.mark.parametrize("others", [1, 9, 10])
def test_few_documents_of_a_language_stay(spark, others):
    """However few documents a language has, those that pass the base rules aren't judged by another language's words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    french = docs.filter("lang = 'fr'").orderBy("doc_id").limit(others)
    out = quality_rules.judge(docs.filter("lang = 'en'").unionByName(french)).filter("lang = 'fr' AND NOT base_failed")
    assert out.count() > 0 and out.filter("kept").count() >= 0.8 * out.count()


@pytest.mark.parametrize("text", ["arrive at home.It was late", "stay at school.So we", "look at this.In fact we", "meet at noon.Be there", "wait at home.Me too", "at work.is it"])
def test_a_sentence_end_is_no_domain(text):
    assert not pii.all_spans(text, pii.base_spans(text))["email"]


@pytest.mark.parametrize("text", ["mail jane.doe at example.com today", "jane at mail.example.org", "jane (at) host.it", "jane@host [dot] it", "jane at host [dot] it"])
def test_disguised_addresses_still_count(text):
    assert len(pii.all_spans(text, pii.base_spans(text))["email"]) == 1


@pytest.mark.parametrize("max_table", [32 << 20, 0])
def test_spans_of_long_texts_are_cut_in_linear_time(spark, max_table):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"start {item} middle. {item}! end"), (2, None), (3, "nothing here"), (4, f"{item} " * 2000 + "tail"), (5, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    out = {r.doc_id: r.text for r in decontaminate.without_spans(docs, bench, max_table=max_table).collect()}
    assert out[1].split() == ["start", "middle.", "!", "end"] and out[2] is None and out[3] == "nothing here" and out[4].split() == ["tail"] and not out[5].split()


def test_the_large_way_moves_no_text_for_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = decontaminate.hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), max_table=0).select("doc_id", F.size("_spans"), "_n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join LeftOuter")[0]
    assert "regexp_extract_all" not in joined
