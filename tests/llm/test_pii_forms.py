"""op4: the boosted trees add forms of personal data that the base patterns miss, and leave other numbers alone."""

import random

import pytest
from pyspark.sql import functions as F

from indexspark.llm import pii

LIKE = ["someone(at)example.com", "joe [at] corp.org", "ann[at]mail[dot]example[dot]net", "(305) 123-4567", "555 123 4567", "(030) 1234-5678",
        "4111/1111/1111/1111", "2001:db8::c0a8:0101"]
UNLIKE = ["2024-01-15", "15.01.2024", "2019-2023", "1.20.3004", "123456.78", "12:30:45:00", "ann@host", "978-3-16-148410-0", "019930026318", "4111/1111/1111/1112"]
WORDS = "the report says that we can meet again near old house when it rains and all others have gone home by then".split()


def _corpus(n=400):
    rng = random.Random(5)
    words = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + digit(14)
        for last in "0123456789":
            worth = [int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body + last)]
            if sum(worth) % 10 == 0:
                return body + last

    for i in range(n):
        personal = [f"mail {rng.choice(WORDS)}.{digit(2)}@mail{digit(1)}.example.com", f"call +1 ({digit(3)}) 555-{digit(4)}", f"card {card()}",
                    "host " + ".".join(str(rng.randrange(1, 255)) for _ in range(4)), f"built in {digit(8)}", f"on 20{digit(2)}-0{digit(1)}-1{digit(1)}"]
        yield i, f"{words(12)} {personal[i % 6]} {words(9)}"


@pytest.fixture(scope="module")
def found(spark):
    texts = dict(_corpus())
    probes = {10_000 + i: f"as he said {form} and went on" for i, form in enumerate(LIKE + UNLIKE)}
    df = spark.createDataFrame([*texts.items(), *probes.items()], "doc_id long, text string").repartition(4)
    rows = pii.report(df).collect()
    return texts, probes, {r.doc_id: r.spans for r in rows}


@pytest.mark.parametrize("n,form", list(enumerate(LIKE)))
def test_added(found, n, form):
    text, spans = found[1][10_000 + n], found[2][10_000 + n]
    places = {tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s}
    start = text.index(form)
    assert any(abs(a - start) <= 1 and b == start + len(form) for a, b in places), spans


@pytest.mark.parametrize("n,form", list(enumerate(UNLIKE, len(LIKE))))
def test_left_alone(found, n, form):
    assert found[2][10_000 + n] == ""


def test_documents_of_plain_numbers_stay_clean(found):
    texts, _, spans = found
    assert [i for i in texts if i % 6 >= 4 and spans[i]] == []
    assert all(spans[i] for i in texts if i % 6 < 4)


def test_labels_of_forms(spark):
    df = spark.createDataFrame([(1, "mail a.b@x.example.com now"), (2, "call +1 (305) 555-1234 now"), (3, "")], "doc_id long, text string")
    n = {r.label: r.n for r in pii.sample(df).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n[1.0] == 42 and n[0.0] >= 20  # fifteen spelt addresses, six national numbers; each in two contexts
