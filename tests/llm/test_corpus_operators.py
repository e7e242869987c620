"""The operators that look at documents together, against brute force and odd inputs."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from fathomline.llm import chat_repair, ngram_join, packing

SMALL = "/root/testdata/sf0.001"


# N-gram join ----------------------------------------------------------------------------------------------------


def components(texts, percent=90):
    sets = {}
    for i, x in texts:
        w = (x or "").encode().lower().split()
        sets[i] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, copies, n=80):
    """Near copies with one to six changed words each, so that some link and some don't."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        ws = list(base)
        for _ in range(rng.randrange(0, 4)):
            ws[rng.randrange(n)] = f"e{rng.randrange(6)}"
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def texts():
    found = [*family(1, 25), *family(2, 10, 40), *family(3, 6, 300)]
    passage = " ".join(f"p{i}" for i in range(30))
    found += [" ".join(f"u{k}_{i}" for i in range(60)) + " " + passage for k in range(15)]
    found += ["", " \n", "one", "One", "one two", "a b c", "A  B\nC", "a b c", "x " * 5000, "x " * 6000]
    random.Random(4).shuffle(found)
    return [*enumerate(found), (999, None)]


@pytest.mark.parametrize("block", [512, 4])
def test_components_are_those_of_all_pairs(spark, texts, block):
    d = spark.createDataFrame([(i, x, "clash", 1) for i, x in texts], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(d, block=block).collect()}
    assert got == components(texts)


def test_components_of_real_documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(d).collect()}
    assert got == components([(r.doc_id, r.text) for r in d.collect()])


def test_one_of_each_component_stays(spark, texts):
    d = spark.createDataFrame([*texts, *texts[:3], (None, "a b c")], "doc_id long, text string")
    kept = ngram_join.one_of_each(d).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, c in components(texts).values()}) and sum(r.doc_id is None for r in kept) == 1
    assert ngram_join.linked_components(d.limit(0)).count() == 0
    assert {r.doc_id: r.component_id for r in ngram_join.linked_components(d.filter("doc_id IS NULL OR doc_id = 0")).collect()}[None] is None


def test_filters_lose_no_pair():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(170, 200)], rng.integers(0, 1 << 63, rng.integers(0, 15), dtype=np.uint64)])) for _ in range(60)]
    v = ngram_join.Verifier([len(s) for s in sets], [ngram_join.histogram(s) for s in sets], 90, sets)
    for i in range(60):
        passed = {j for j in v.candidates(i, np.arange(60)) if v.linked(i, j)}
        exact = {j for j in range(60) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - c)}
        assert passed == exact


# Packing --------------------------------------------------------------------------------------------------------


def test_encoder_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    wanted = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.CachedEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "é", "12", "'s", "!", "...", "　", "ß", "<|endoftext|>", "Ⅷ", "½", "\r\n", " I'll", "☃"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(10)))
        assert np.frombuffer(encode(x), "<u4").tolist() == wanted.encode(x, add_special_tokens=False).ids, repr(x)


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 64, 2048])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))}
        made = packing.plan(counts, capacity)
        room: dict[int, list[tuple[int, int]]] = {}
        for n, runs in made.runs.items():
            ranks = [r[0] for r in runs] + [counts[n]]
            assert ranks == sorted(ranks) and ranks[0] == 0
            for (rank, first, each, offset), after in zip(runs, ranks[1:], strict=True):
                for k in range(after - rank):
                    room.setdefault(first + k // each, []).append((offset + k % each * n, n))
        assert sorted(room) == list(range(made.sequences))
        for places in room.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= capacity
        assert made.sequences <= 1 + 1.25 * -(-sum(n * c for n, c in counts.items()) // capacity) + max(counts.values()) / 2


@pytest.mark.parametrize("per_salt", [50_000, 7])
def test_packed_documents_are_whole(spark, per_salt):
    import public_tokenizers
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9000), (10**6 + 3, "x"), (10**6 + 3, "x")], "doc_id long, text string"))
    cut = packing.pieces(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = packing.pack(cut, per_salt=per_salt).toPandas()
    for r in d.dropDuplicates(["doc_id"]).collect():
        ids = k.encode(r.text or "", add_special_tokens=False).ids + [0]
        own = out[out.doc_id == r.doc_id].drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    placed = out.sort_values(["sequence_id", "offset"])
    assert ((placed.groupby("sequence_id").length.cumsum() - placed.length) == placed.offset).all()
    sums = placed.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= -(-int(out.length.sum()) // 2048) + 1
    assert packing.pack(cut.limit(0)).count() == 0


# Chat -----------------------------------------------------------------------------------------------------------


def least_cost(roles):
    states, costs, best = chat_repair.STATES, chat_repair.COSTS, 10**9
    for given in itertools.product(range(1, 4), repeat=len(roles)):
        for merges in itertools.product((0, 1), repeat=len(roles)):
            at, cost = 0, 0
            for r, t, m in zip(roles, given, merges, strict=True):
                cost += 0 if r == states[t] else costs["relabel"]
                made = chat_repair.BETWEEN[states[at], states[t]]
                if m and at != t or not m and made is None:
                    break
                cost += costs["merge"] if m else costs["insert"] * len(made)
                at = t
            else:
                best = min(best, cost + costs["insert"] * len(chat_repair.ENDING[states[at]]))
    return best


@pytest.mark.parametrize("block", [1024, 2])
def test_repairs_cost_least_and_are_legal(spark, block):
    rng = random.Random(7)
    talks = {c: [rng.choice(["system", "User ", "assistant", "tool", None]) for _ in range(rng.randrange(1, 6))] for c in range(40)}
    plain = lambda r: r and r.strip().lower() if r and r.strip().lower() in chat_repair.ROLES else None
    rows = [(c, i, r, f"t{c}.{i}") for c, rs in talks.items() for i, r in enumerate(rs)]
    d = spark.createDataFrame([(*r, "clash") for r in rows + rows[:5]], "conv_id long, turn long, role string, text string, block string")
    out = chat_repair.repair(d.drop("block"), block=block).toPandas()
    assert len(out) == len(rows)
    assert out.groupby("conv_id").cost.sum().to_dict() == {c: least_cost([plain(r) for r in rs]) for c, rs in talks.items()}
    for c, x in out.sort_values(["turn", "place"]).groupby("conv_id").rendered.sum().items():
        roles = re.findall(r"<\|im_start\|>(\w+)\n", x)
        turns = roles[1:] if roles[0] == "system" else roles
        assert turns == ["user", "assistant"] * (len(turns) // 2) and x.count("<|im_end|>\n") == len(roles)
        assert all(f"t{c}.{i}" in x for i in range(len(talks[c])))


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (1, 5, "assistant", "x"), (1, 5, "assistant", "x"), (1, 5, "assistant", "y"), (2, 0, "user", "a" * 200000), (3, -4, "assistant", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_repair.query(d).collect()
    assert len(out) == 6 and chat_repair.query(d.limit(0)).count() == 0
    assert [r.action for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.place)] == ["relabel", "keep"]  # 4, less than an empty user turn and a merge


def test_one_long_conversation_is_cut_into_blocks(spark):
    d = spark.range(5000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "'t' AS text")
    whole, cut = (chat_repair.repair(d, block=b).agg({"cost": "sum"}).first()[0] for b in (10**6, 64))
    assert whole == cut
