"""Periodic runs, byte-level BPE and the alignment of tokenizers, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from fathomline.llm import byte_bpe, periodic_runs, token_alignment

SMALL = "/root/testdata/sf0.001"
ROWS = [
    (1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "  \n\t "), (5, "a " * 40), (6, "x" * 30_000 + " y"), (None, "no id " * 9),
    (7, " leading and  double  spaces \n and trailing "), (8, "<|endoftext|> and <s> and <0x41> ▁ mark"), (9, "plain <|endoftext|> <s> <0x41>"),
    (10, "café café ﬁ 日本語 \U0001f600 \x00 end"), (11, "tab\there\nline \nnext nbsp"), (12, "-" * 3000), (20, "k l m " * 500 + "end " + "k l m " * 20),
    (10**15, "word " * 12), (-3, "ab ab ab ab ab ab ab"), (13, "▁"), (14, "it's we'll THEY'LL 1234567 x1y2"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS DOC", "doc_id AS key", "text AS words", "1 AS part", "2 AS uid")


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").unionByName(odd.select("doc_id", "text"))


def plain_runs(x):
    got = {}
    for q in range(1, len(x) // 2 + 1):
        i = q
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[j - q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                got.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in got.items())


def periodic_text(rng, n):
    x, letters = [], rng.choice([1, 2, 2, 3, 5])
    while len(x) < n:
        if x and rng.random() < 0.6:
            size = rng.randint(1, min(len(x), 40))
            start = len(x) - size if rng.random() < 0.7 else rng.randint(0, len(x) - size)
            x += x[start : start + size] * rng.randint(1, 4)
        else:
            x += [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.1:
            x = x[: -rng.randint(1, 3)] or [0]
    return x[:n]


def test_runs_by_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        x = periodic_text(rng, rng.choice([0, 5, 11, 12, 13, 20, 40, 80, 160, 320])) if rng.random() < 0.7 else [rng.randrange(2) for _ in range(rng.choice([12, 30, 100, 300]))]
        assert periodic_runs.runs(x, periodic_runs.links(np.array(x, dtype=np.int64))) == plain_runs(x)
    fibonacci, thue = [0, 1], [bin(i).count("1") & 1 for i in range(600)]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for x in (b, thue, fibonacci * 150, [0] * 300 + [1] + [0] * 299, ([0] * 60 + [1]) * 9):
        assert periodic_runs.runs(x, periodic_runs.links(np.array(x))) == plain_runs(x)


def test_runs_of_regions_that_touch():
    """Two regions of one period, shifted: every period between them is a run of its own."""
    for p in (2, 3, 5, 7):
        unit = list(range(p))
        for cut in range(1, p):
            for left, right in ((9, 9), (20, 6), (6, 20), (40, 40)):
                x = unit * left + (unit[cut:] + unit[:cut]) * right
                assert periodic_runs.runs(x, periodic_runs.links(np.array(x))) == plain_runs(x)


def test_runs_of_long_texts_take_a_pass():
    for x, most in (([0] * 300_000, 9), ([0] * 50_000 + [1] + [0] * 50_000, 99), (([0] * 9000 + [1]) * 10, 999)):
        linked = periodic_runs.links(np.array(x))
        assert len(linked) < most and periodic_runs.runs(x, linked)


def test_periodic_runs_query(docs):
    wanted = Counter()
    for r in docs.collect():
        words = [w for w in (r.text or "").encode().split() if w]
        h, n = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b""), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words) if n < 3500 else pytest.fail("too long for brute force")
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else None
        wanted[(r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())] += 1
    got = Counter(map(tuple, periodic_runs.query(docs).collect()))
    assert got == wanted and sum(k[1] > 0 for k in wanted) > 5


def test_perfect_hash_is_minimal():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 100, 3000):
        keys = list({rng.randbytes(rng.randint(1, 9)) for _ in range(n)})
        table = byte_bpe.PerfectHash(keys)
        assert [table.place(k) for k in keys] == list(range(len(keys))) and sorted(v for v in table.values if v >= 0) == list(range(len(keys)))
        assert all(table.place(x) == -1 for x in (b"", b"0123456789ab"))


def test_merges_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 12:
            ranks.setdefault(b"".join(rng.choices(list(ranks), k=2)), len(ranks))
        piece = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
        parts = [bytes([c]) for c in piece]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merged(piece, ranks) == [ranks[p] for p in parts]


def test_byte_bpe_query(docs, odd):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = Counter()
    for r in docs.collect():
        ids = t.encode_ordinary(r.text or "")
        wanted[(r.doc_id, len(ids), sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.query(docs).collect())) == wanted
    assert byte_bpe.query(odd).count() == len(ROWS) and byte_bpe.query(odd.limit(0)).isEmpty()


def test_heap_takes_long_pretokens():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = byte_bpe.merged(b"a" * 200_000, ranks)
    by = {i: k for k, i in ranks.items()}
    assert b"".join(by[i] for i in ids) == b"a" * 200_000


def plain_alignment(texts):
    """Rows of the alignment, by whole texts and all pairs of a group."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    tok = Tokenizer.from_file(a_path)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_bytes, b_bytes = token_alignment.bytes_of_a(a_path), token_alignment.bytes_of_b(b_path)
    spans = lambda ids, of: [(i, s, s + len(of[i])) for i, s in zip(ids, np.cumsum([0] + [len(of[i]) for i in ids]).tolist())]
    rows, held = [], defaultdict(set)
    for k, text in enumerate(texts):
        a = spans(tok.encode(" " + text, add_special_tokens=False).ids, a_bytes) if text else []
        b = spans(sp.encode(text), b_bytes) if text else []
        if not text or not b"".join(a_bytes[i] for i, *_ in a) == f" {text}".encode() == b"".join(b_bytes[i] for i, *_ in b):
            rows.append((0, 0, 0, [], ""))
            continue
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, linked, s = [], [], 0
        for e in ends:
            ga, gb = [t for t in a if s <= t[1] < e], [t for t in b if s <= t[1] < e]
            groups.append(f"{','.join(str(t[0]) for t in ga)}|{','.join(str(t[0]) for t in gb)}")
            linked += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            s = e
        rows.append((len(a), len(b), len(groups), linked, sha256(";".join(groups).encode()).hexdigest()))
        for pair in set(linked):
            held[pair].add(k)
    count = {p: len(ks) for p, ks in held.items()}
    best = {}
    for (x, _), c in count.items():
        best[x] = max(best.get(x, 0), c)
    return [(na, nb, ng, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), digest) for na, nb, ng, ls, digest in rows]


@pytest.mark.parametrize("hot_share", [token_alignment.HOT_SHARE, 40, 1])
def test_alignment_query(docs, hot_share):
    d = docs.filter("doc_id IS NULL OR doc_id <> 6 AND doc_id % 2 = 0 OR doc_id < 20")
    rows = d.collect()
    wanted = Counter((r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows])))
    assert Counter(map(tuple, token_alignment.query(d, hot_share=hot_share).collect())) == wanted


def test_alignment_of_odd_tables(odd):
    assert token_alignment.query(odd).count() == len(ROWS)
    assert token_alignment.query(odd.limit(0)).isEmpty()
    assert token_alignment.query(odd.filter("text IS NULL")).drop("doc_id").distinct().collect() == [(0, 0, 0, 0, 0, 0, "")]


def test_encoders_and_bytes_agree_with_the_files():
    from tokenizers import Tokenizer

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligner = token_alignment.Aligner(a_path, b_path, public_tokenizers.PATTERN)
    tok = Tokenizer.from_file(a_path)
    tok.encode_special_tokens = True
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "the", "B", " ", " ", "  ", "\n", "\t", "é", "9", ".", "'s", "日", "\x00", "\u00a0", "<s>", "\u0085", "<|endoftext|>", "\u2581"]) for _ in range(rng.randint(1, 14)))
        a, b = (x[0] for x in aligner.encode([text]))
        assert bool(a) == bool(b) == ("\u2581" not in text) and (not a or a == tok.encode(" " + text, add_special_tokens=False).ids)


class Small:
    """A hand-made pair of vocabularies, in place of an Aligner."""

    a_bytes, b_bytes = [b" ", b"x", b"xy", b"y"], [b" ", b"x", b" x", b"yx", b"y"]
    a_length, b_length = np.array([1, 1, 2, 1]), np.array([1, 1, 2, 2, 1])
    written = [f"{i}{end}".encode() for n, end in ((4, ","), (4, "|"), (5, ","), (5, ";")) for i in range(n)]


def test_a_pair_of_the_map_inside_another_group():
    identity = token_alignment.identity_map(Small.a_bytes, Small.b_bytes)
    assert identity.tolist() == [0, 1, -1, 4]
    found = token_alignment.Alignment([[0, 1, 3, 1], [], [0, 1, 1]], [[0, 1, 3], [], [2, 1]], Small)
    assert list(zip(found.link_of.tolist(), found.link_a.tolist(), found.link_b.tolist())) == [(0, 0, 0), (0, 1, 1), (0, 3, 3), (0, 1, 3), (2, 0, 2), (2, 1, 2), (2, 1, 1)]
    assert found.digests(Small) == [sha256(b"0|0;1|1;3,1|3").hexdigest(), "", sha256(b"0,1|2;1|1").hexdigest()]
    inner = token_alignment.Alignment([[2, 1]], [[1, 4, 1]], Small)  # x and y apart in B, together in A
    assert inner.counts(inner.a_of[inner.a_last]).tolist() == [2] and inner.counts(inner.link_of).tolist() == [3]


def test_queries_take_whole_tables(spark):
    from fathomline.llm import queries

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op11_periodic_runs", "op12_byte_bpe", "op13_token_alignment"):
        out = queries.queries()[name](spark, SMALL)
        assert out.count() == n and out.filter(F.col("doc_id").isNull()).isEmpty()
