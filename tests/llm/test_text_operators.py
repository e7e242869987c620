"""The operators that look at each text on its own, against brute force and odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, language_id, pii, quality_classifier, quality_rules, queries, token_counts, toxicity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "the " * 30000), (5, "a b c"), (5, "a b c"), (None, "null id here"), (6, "�\u0000 ☃ 𝔘nicode é"), (7, "x" * 50000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, None if k % 2 else "en", "s", 0, "clash", k) for k, (i, x) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _n string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Language -------------------------------------------------------------------------------------------------------


def test_forward_backward_is_that_of_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    lengths, k = np.array([4, 2, 1]), 3
    emissions, moves = rng.normal(size=(7, k)), rng.normal(size=(k, k))
    p, log_z, pairs = language_id.forward_backward(emissions, lengths, moves, want_pairs=True)
    at, want_z, want_pairs = 0, 0.0, np.zeros((k, k))
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        w = np.array([np.exp(sum(emissions[at + i, y] for i, y in enumerate(ys)) + sum(moves[a, b] for a, b in zip(ys, ys[1:], strict=False))) for ys in paths])
        want_z += np.log(w.sum())
        for i in range(n):
            for y in range(k):
                assert p[at + i, y] == pytest.approx(sum(x for x, ys in zip(w, paths, strict=True) if ys[i] == y) / w.sum())
        for x, ys in zip(w, paths, strict=True):
            for a, b in zip(ys, ys[1:], strict=False):
                want_pairs[a, b] += x / w.sum()
        at += n
    assert log_z == pytest.approx(want_z) and pairs == pytest.approx(want_pairs)


def test_languages_of_held_out_documents_and_of_switching_text(spark, docs):
    model = language_id.fit(language_id.sampled_runs(docs, per_language=60))
    out = language_id.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    labels = language_id.label_words(["the and of that is with of the le la que des un du est pas la der die und nicht ein eine das"], model)[0]
    assert dict(labels[2:6]) == dict.fromkeys(["of", "that", "is", "with"], "en") and labels[-3][1] == "de" and labels[11][1] == "fr"


def test_language_of_odd_texts(odd, spark):
    model = language_id.fit([("en", ["the", "and"]), ("fr", ["le", "et"])] * 5)
    rows = language_id.label(odd, model).collect()
    assert len(rows) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred == "und" for r in language_id.label(odd, None).collect())
    assert language_id.query(odd.limit(0)).count() == 0 and language_id.words("½ Ⅷ 12_a") == ["a"]


# Decontamination ------------------------------------------------------------------------------------------------


def hit_words(text, items):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    ws, hit, found = split(text), set(), set()
    for item, x in items:
        bs = split(x)
        for w in [bs[i : i + 13] for i in range(max(len(bs) - 12, 1))] if bs else []:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(ws), hit, sorted(found)


def test_decontamination_rows_are_those_of_the_sql(spark):
    assert_same(queries.op2_decontaminate(spark, SMALL).toPandas(), decontaminate.ORACLE, SMALL)


def test_quality_rows_are_those_of_the_sql(spark):
    assert_same(queries.op4_quality_rules(spark, SMALL).toPandas(), quality_rules.oracle(), SMALL)


@pytest.mark.parametrize("limits", [{}, {"max_table": 0}])
def test_decontamination_by_brute_force(spark, limits):
    rng = np.random.default_rng(1)
    vocabulary = ["a", "B", "é", "Zz", "9", "long1"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, say(15)), (2, say(13)), (10, say(3)), (3, None), (4, "..."), (5, "a, B-é")]
    texts = [(k, say(40)) for k in range(20)] + [(20, "x " + items[0][1] + " y"), (21, None), (22, ""), (23, items[2][1]), (23, items[2][1]), (24, items[1][1].upper())]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.hits(d, b, **limits).withColumn("p", decontaminate._positions()).collect()
    assert len(rows) == len(texts)
    want = Counter((i, n, frozenset(h), tuple(f)) for i, (n, h, f) in ((i, hit_words(x, items)) for i, x in texts))
    assert Counter((r.doc_id, r["_n"], frozenset(r.p), tuple(r["_items"])) for r in rows) == want


def test_decontamination_keeps_columns_and_removes_spans(spark, odd):
    b = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    kept = decontaminate.clean(odd.drop("_n"), b)
    assert kept.columns == odd.drop("_n").columns and kept.filter("doc_id = 5").isEmpty() and kept.count() == len(ODD) - 2
    d = spark.createDataFrame([(1, "x, A b; y"), (2, None), (3, "Say a. B!")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.without_spans(d, b).collect()} == {1: "x,  ; y", 2: None, 3: "Say . !"}
    assert decontaminate.query(d, b.limit(0)).filter("n_hit > 0").isEmpty() and decontaminate.query(d.limit(0), b).count() == 0


# Toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.query(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.02 and out.score.between(0, 1).all()
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_risk_is_non_negative_and_corrected_by_the_prior():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    text = lambda bad: " ".join([*rng.choice(words, 20), *(["awful"] if bad else [])])
    model = toxicity.fit_nnpu([text(True) for _ in range(100)], [text(i % 10 == 0) for i in range(1000)], 0.1)
    assert model.score("awful w1") > 0.5 > model.score("w1 w2 w3") and model.score(None) == model.score("")
    assert toxicity.fit_nnpu([], ["x"], 0.1).score("x") < 1e-6


def test_toxicity_of_odd_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.query(odd, none).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 for r in rows) and toxicity.keep_clean(odd, none).columns == odd.columns
    assert toxicity.query(odd.limit(0), none).count() == 0


# Quality --------------------------------------------------------------------------------------------------------


def measured(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = list(zip(ws, ws[1:], ws[2:], strict=False))
    often = Counter(three)
    again = {i + j for i, t in enumerate(three) if often[t] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_rules_by_brute_force(spark, docs):
    rows = quality_rules.query(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(tuple(r[c] for c in BASE) == measured(r.text) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in rows) and not any(r.kept and r.base_failed for r in rows)


def test_many_words_take_the_other_way_to_the_same_result(spark, odd, monkeypatch):
    fast = sorted(map(str, quality_rules.base(odd).select("doc_id", *BASE).collect()))
    monkeypatch.setattr(quality_rules, "_PLACES", 2)
    assert sorted(map(str, quality_rules.base(odd).select("doc_id", *BASE).collect())) == fast
    assert {r.doc_id: tuple(r[c] for c in BASE) for r in quality_rules.base(odd).collect()} == {i: measured(x) for i, x in ODD}


def test_divergence_of_histograms(spark):
    c = F.array(F.lit(3), F.lit(1)).cast("array<bigint>")
    js = spark.range(1).select(quality_rules.distance(c, [0.5, 0.5])).first()[0]
    p, q, m = np.array([0.75, 0.25]), np.array([0.5, 0.5]), np.array([0.625, 0.375])
    assert js == pytest.approx(np.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2))
    assert spark.range(1).select(quality_rules.distance(c, [0.75, 0.25])).first()[0] == pytest.approx(0)


def test_rules_keep_good_and_drop_noise(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_rules.query(docs).join(labels, "doc_id").toPandas()
    good = out[(out.quality == 1) & ~out.base_failed]
    assert good.kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.3


def test_texts_without_common_words_are_dropped_and_prose_kept(spark, docs):
    made = [x + y for x in ("mar", "telo", "bri", "sunda", "kel", "vo", "nari", "plos") for y in ("ket", "dion", "lun", "mera", "sto", "fin", "gal")]
    salad = " ".join(w.title() if k % 8 == 0 else w + "." if k % 8 == 7 else w for k, w in enumerate(made))
    prose = (
        "The history of the town is told by the people that live in it, and most of them know the story of the old bridge. It was built for the "
        "king in a hard winter, with stone that came down the river on boats. As the years went by, the market moved to the other side, "
        "and the road on the hill is used only by farmers with their carts."
    )
    unknown = (
        "Talo seisoo mäen takana, missä vanhat puut kasvavat hitaasti. Kesällä lapset kulkevat metsään ja etsivät marjoja, talvella miehet istuvat "
        "sisällä korjaamassa verkkoja. Joen rannalla asuu kalastaja, jonka vene on sininen. Hän nousee aikaisin, kun sumu vielä peittää veden, sekä "
        "palaa iltapäivällä kylään myymään saaliinsa. Naapurit ostavat siikaa, haukea, ahventa. Illalla kaikki kokoontuvat saunaan kertomaan tarinoita."
    )
    assert all(len(x.split()) >= 50 for x in (salad, prose, unknown))
    more = spark.createDataFrame([(-1, "en", salad), (-2, "en", prose), (-3, None, unknown)], "doc_id long, lang string, text string")
    out = {r.doc_id: r for r in quality_rules.judge(docs.select("doc_id", "lang", "text").unionByName(more)).filter("doc_id < 0").collect()}
    assert not any(r.base_failed for r in out.values()) and all(r.js_classes < quality_rules.LIMITS["classes"] for r in out.values())
    assert {i: r.kept for i, r in out.items()} == {-1: False, -2: True, -3: False}


def test_quality_of_odd_tables(spark, odd):
    assert quality_rules.query(odd).count() == len(ODD) and quality_rules.query(odd.limit(0)).count() == 0


def test_quality_of_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.query(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((out.predicted == out.quality).mean() > 0.98) and (out[out.quality == 0].predicted == 0).mean() > 0.9
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_dual_coordinate_descent_finds_the_least_objective():
    rng = np.random.default_rng(0)
    x, y = (rng.random((60, 8)) < 0.4).astype(float), rng.choice([-1, 1], 60)
    values = rng.normal(size=8)
    w, b = quality_classifier.descend([np.flatnonzero(r) for r in x], values, y, np.full(60, 0.5), passes=2000)
    z = np.hstack([x * values, np.ones((60, 1))])
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (z @ v)).sum()
    v = np.append(w, b)
    assert all(loss(v) <= loss(v + d) + 1e-6 for d in rng.normal(size=(300, 9)) * 0.02)


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality_classifier.query(odd, none).collect()} == {0.5}
    assert quality_classifier.fit(["a", "b"], [1, 1]).score("x", quality_classifier.Shapes()) > 0.99


# Personal data --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("bob@mail.example.com and 10.0.0.256 and 10.0.0.255", "email:0:20,ip:40:50"),
        ("card 4111 1111 1111 1111, 4111 1111 1111 1112", "card:5:24"),
        ("tel +1 (555) 555-0100 x", "phone:4:21"),
        ("bob at mail dot example dot com now", "email:0:31"),
        ("bob [at] mail7 [dot] example.com", "email:0:32"),
        ("ｂob＠ｍail.example.com", "email:0:20"),
        ("four one one one one one one one one one one one one one one one", "card:0:64"),
        ("ip one nine two dot one six eight dot one dot one", "ip:3:49"),
        ("call plus one five five five one two three four five six seven ok", "phone:5:62"),
        ("we met at noon. Then dot by dot", ""),
        ("look at this one or two or three things", ""),
        ("", ""),
    ],
)
def test_spans(text, spans):
    assert pii.digest(pii.all_spans(text, pii.base_spans(text))) == spans


@pytest.mark.parametrize(
    ("disguised", "kind"),
    [
        ("john at example.com", "email"),
        ("john_AT_example.com", "email"),
        ("john-at-example.com", "email"),
        ("john { at } example.com", "email"),
        ("john <at> example.com", "email"),
        ("john@example ( . ) com", "email"),
        ("john@example . com", "email"),
        ("john @ example.com", "email"),
        ("10[ . ]2[ . ]3[ . ]4", "ip"),
        ("10<.>2<.>3<.>4", "ip"),
        ("plus four-four-two-zero-seven-nine-four-six-one-two", "phone"),
        ("one.two.three.four", "ip"),
        ("+four,four,two,zero,seven,nine,four,six,oh", "phone"),
    ],
)
def test_disguises_need_no_hint_elsewhere(disguised, kind):
    spans = lambda x: pii.digest(pii.all_spans(x, pii.base_spans(x)))
    wanted = f"{kind}:0:{len(disguised)}"
    assert spans(disguised) == wanted and spans(f"{disguised}\n\nThe point, dot (at) one two three") == wanted


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("ip 192.168.1[.]1 x", "ip:3:16"),
        ("ip 10.0[.]0.7", "ip:3:13"),
        ("ip 10[ . ]0.0 dot 7", "ip:3:19"),
        ("v 1.2.3 then 4[.]5", ""),
        ("1.2.3.4 or 1[.]2.3.256", "ip:0:7"),
        ("card 4111 1111 1111 one 1 1 one", "card:5:31"),
        ("card 4111 1111 1111 one 1 1 two", ""),
        ("tel +1 (555) five 55-0100 x", "phone:4:25"),
        ("ip 192.168.one.7", "ip:3:16"),
        ("ip 192 dot 168 dot one dot 7", "ip:3:28"),
        ("anna at firma dot dk", "email:0:20"),
        ("anna at firma.in", "email:0:16"),
        ("anna at firma (dot) in", "email:0:22"),
        ("she looked at the dot in it, at noon . It was", ""),
        ("in 2020 one of 12 or two, 13 of them", ""),
    ],
)
def test_mixed_disguises(text, spans):
    assert pii.digest(pii.all_spans(text, pii.base_spans(text))) == spans


def test_long_rules_of_dashes_take_no_time():
    assert pii.normalise("-" * 200_000 + "_" * 200_000 + " " * 200_000).text[:1] == "-"


def test_masked_texts(spark, odd):
    d = spark.createDataFrame([(1, "a@b.example.com, +1 (555) 555-0100"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(d).collect()} == {1: "[EMAIL], [PHONE]", 2: None}
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD) and pii.redacted(odd).columns == odd.columns and pii.find(odd.limit(0)).count() == 0


def test_offsets_point_to_the_source():
    text = "☃ é " + "b​ob (at) mаil (dot) example (dot) com" + " end"
    (kind, start, end), = [s.split(":") for s in pii.digest(pii.all_spans(text, pii.base_spans(text))).split(",")]
    assert kind == "email" and text[int(start) : int(end)] == "b​ob (at) mаil (dot) example (dot) com"


# Token counts ---------------------------------------------------------------------------------------------------


def greedy(word, pieces):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return -1
        i, n = j, n + 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = np.random.default_rng(3)
    for _ in range(150):
        pieces = {bytes(rng.integers(0, 3, rng.integers(1, 6)).astype(np.uint8)) for _ in range(rng.integers(1, 15))}
        ws = [bytes(rng.integers(0, 3, rng.integers(1, 10)).astype(np.uint8)) for _ in range(30)]
        assert token_counts.Automaton.build(pieces).counts(ws).tolist() == [greedy(w, pieces) for w in ws]


def test_token_counts_by_brute_force(spark, odd):
    import public_tokenizers

    pieces = token_counts.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    longest = max(map(len, pieces))

    def fast(w):
        i = n = 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in pieces)
            n += 1
        return n

    d = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = d.collect()
    got = Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.query(d).collect())
    assert got == Counter((r.doc_id, len(ws), sum(fast(w.encode()) for w in ws), 0) for r, ws in ((r, token_counts.words(r.text)) for r in texts))
    assert token_counts.query(odd).count() == len(ODD)


def test_every_held_out_flag_is_the_crc(spark):
    rows = toxicity.query(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
