"""Personal data against an independent finder, and on long runs."""

import random
import re
import time

import pytest

from fathomline.llm import pii


def luhn(digits):
    ds = [int(c) for c in digits][::-1]
    return (sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])) % 10 == 0


def plain(text):
    """The contract's patterns, run as they are."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    of = lambda p, test=lambda x: True: [m.span() for m in re.finditer(p, text) if test(m[0])]
    return {
        "email": of(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": of(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": of(r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": of(r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }


@pytest.mark.parametrize("alphabet", ["ab@.-_1", "12.0 -+()", "1234567890 -", "a@b.c +1.2-() 0\n"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_of_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        found = pii.base_spans(r.text or "")
        assert found == plain(r.text or "")
        every = pii.all_spans(r.text or "", found)
        assert all(set(found[k]) <= set(every[k]) for k in pii.KINDS)


@pytest.mark.parametrize(
    "run",
    ["1", "1.", "a", "@", "a@", "1[.]", "x-at-", "x-dot-9-dot-", "a at ", "a dot ", "one ", "1 ", " ", "[ ", "-", "zero-", "bob [at] mail [dot] com "],
)
def test_long_runs_take_time_that_grows_with_their_length(run):
    text = "a@b.co +1 " + run * (300_000 // len(run)) + " at x"
    began = time.time()
    pii.redact(text, pii.all_spans(text, pii.base_spans(text)))
    assert time.time() - began < 8


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("JOHN_AT_EXAMPLE.com", ["JOHN_AT_EXAMPLE.com"]),
        ("mail john at example.com now", ["john at example.com"]),
        ("john at example.com . Then we", ["john at example.com"]),
        ("info at shop-at-home.com", ["info at shop-at-home.com"]),
        ("a.b.c.d.e.f at x.com", ["a.b.c.d.e.f at x.com"]),
        ("a-dot-b-at-mail-dot-example-dot-com", ["a-dot-b-at-mail-dot-example-dot-com"]),
        ("call plus four-four-two-zero-seven-nine-four-six-one-two", ["plus four-four-two-zero-seven-nine-four-six-one-two"]),
    ],
)
@pytest.mark.parametrize("around", ["", ", the point is", "\nsee you at noon dot", " (at) two three"])
def test_what_is_found_does_not_depend_on_other_words(text, found, around):
    spans = pii.all_spans(text + around, pii.base_spans(text + around))
    assert [(text + around)[a:b] for k in pii.KINDS for a, b in spans[k]] == found


def test_overlapping_spans_go_as_one():
    text = "x 10.0.0.4-111-1111-1111-1111 y"
    spans = pii.all_spans(text, pii.base_spans(text))
    assert spans["ip"] and spans["card"] and pii.redact(text, spans) == "x [CARD] y"
    assert pii.redact("abcdef", {"email": [(0, 2)], "ip": [(2, 4)], "card": [], "phone": [(2, 4)]}) == "[EMAIL][IP]ef"
