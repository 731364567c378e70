"""Each labeler and feature of personal data on hand-made sentences, and precision and recall of planted forms by kind."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm import pii

#: sentence, kind, strict, whether its test holds, span, and what is expected of labelers and features.
SAID = [
    ("write to joe@mail.org today", 0, True, True, "joe@mail.org", {"v_regex": 1, "v_check": 1, "v_gazetteer": 1, "v_edges": 1, "f_left": 1, "f_right": 1, "f_first": 1}),
    ("write joe [at] mail [dot] org", 0, False, False, "joe [at] mail [dot] org", {"v_regex": 0, "v_check": 1, "v_gazetteer": 1, "v_context": 1, "v_edges": 1, "f_right": 0, "f_length": 5}),
    ("joe [at] mail.zzz, he said", 0, False, False, "joe [at] mail.zzz", {"v_check": 1, "v_gazetteer": -1, "v_context": 0, "v_edges": 1, "f_left": 0, "f_right": 4}),
    ("x joe [at] 12 . 34x", 0, False, False, "joe [at] 12 . 34", {"v_check": -1, "v_gazetteer": -1, "v_edges": -1, "f_right": 3}),
    ("the server 10.1.2.3 is up", 1, True, True, "10.1.2.3", {"v_gazetteer": 0, "v_context": 1, "v_edges": 1, "f_first": 0}),
    ("see 127.0.0.1s", 1, True, True, "127.0.0.1", {"v_gazetteer": -1, "v_context": 0, "v_edges": -1, "f_right": 3}),
    ("version 1.2.3.4.", 1, True, True, "1.2.3.4", {"v_context": -1, "v_edges": 1}),
    ("host 2001:db8::1, port 1", 1, False, False, "2001:db8::1", {"v_regex": 0, "v_check": 1, "v_context": 1, "v_edges": 1, "f_length": 2}),
    ("a ::: b", 1, False, False, "::", {"v_check": -1}),
    ("visa 4111 1111 1111 1111.", 2, True, True, "4111 1111 1111 1111", {"v_gazetteer": 1, "v_context": 1, "v_groups": 1}),
    ("order 9111-11111111", 2, True, False, "9111-11111111", {"v_check": -1, "v_gazetteer": -1, "v_context": -1, "v_groups": -1}),
    ("tel: +49 30 1234567", 3, True, True, "+49 30 1234567", {"v_gazetteer": 1, "v_context": 1, "v_edges": 1, "v_groups": 1, "f_first": 2}),
    ("ring 030/1234567 (fax)", 3, False, False, "030/1234567", {"v_regex": 0, "v_check": 1, "v_context": 1, "v_edges": 1, "v_groups": 1}),
    ("teléfono 612 345 678", 3, False, False, "612 345 678", {"v_check": 1, "v_context": 1, "v_edges": 1}),
    ("id 112-555-1234_", 3, False, False, "112-555-1234", {"v_check": -1, "v_context": -1, "v_edges": -1, "f_right": 4}),
    ("7 212-555-1234 5", 3, False, False, "212-555-1234", {"v_check": 1, "v_edges": 1, "f_left": 1, "f_right": 1}),
    ("a+1 23 456 7890", 3, True, True, "+1 23 456 7890", {"v_edges": -1, "f_left": 3}),
    ("5+1 23 456 7890", 3, True, True, "+1 23 456 7890", {"f_left": 2}),
    ("x=+1 23 456 78907", 3, True, True, "+1 23 456 7890", {"f_left": 4, "f_right": 2}),
]


def test_every_labeler_and_feature(spark):
    rows = []
    for text, k, strict, ok, span, _ in SAID:
        at = text.index(span)
        rows.append((k, strict, ok, span, text[:at][-pii.LEFT :], text[at + len(span) :][: pii.RIGHT]))
    d = spark.createDataFrame(rows, "k int, strict boolean, ok boolean, text string, left string, right string").coalesce(1)
    all_ = pii.votes(pii.Gazetteers()) | pii.features()
    found = d.select(F.struct("*").alias("x")).select(*[F.expr(sql).alias(name) for name, sql in all_.items()]).collect()
    for row, (text, *_, want) in zip(found, SAID, strict=True):
        assert {name: row[name] for name in want} == want, text
    seen = {name: {row[name] for row in found} for name in all_}
    assert {name for name, values in seen.items() if len(values) < 2} == set()  # none is dead
    assert seen["v_edges"] == {-1, 1} and seen["f_left"] == {0, 1, 2, 3, 4} and seen["f_right"] == {0, 1, 2, 3, 4}


def planted(seed, n):
    """Sentences with one planted span of a kind and one look-alike that is none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda: f"{r.randrange(1, 65536):x}"
    good = {
        "email": [lambda: f"joe{d(2)} [at] mail.example [dot] org", lambda: f"ann.{d(2)}(at)host.de", lambda: f"kim{d(1)} (at) post (dot) net"],
        "ip": [lambda: f"2001:db8:{h()}:1:2:3:4:{h()}", lambda: f"2001:db8::{h()[:3]}9", lambda: f"fe80::{h()[:3]}1:{h()}", lambda: f"2a02:{h()}:5::"],
        "phone": [
            lambda: f"{r.choice('23456789')}{d(2)}-{r.choice('23456789')}{d(2)}-{d(4)}", lambda: f"({r.choice('23456789')}{d(2)}) {r.choice('23456789')}{d(2)}-{d(4)}",
            lambda: f"030/{r.choice('123456789')}{d(6)}", lambda: f"01 {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"6{d(2)} {d(3)} {d(3)}", lambda: f"020 7946 {d(4)}",
        ],
    }
    said = {"email": ["write to {}", "mail: {}", "{}"], "ip": ["host {}", "server {}", "{}"], "phone": ["call {}", "tel. {}", "teléfono {}", "{}"]}
    bad = [lambda: f"order {r.choice('01')}1{d(1)}-{d(3)}-{d(4)}", lambda: f"std::cout{d(2)}", lambda: f"figure 0{r.randrange(1, 9)}-12-20{d(2)}", lambda: f"at {d(1)}:{d(2)}:{d(2)}", lambda: f"see x{d(1)} [at] 12 . 34", lambda: "999.1.2.3", lambda: "ratio a::b"]
    rows, spans = [], []
    for i in range(n):
        kind = r.choice(list(good))
        yes = r.choice(good[kind])()
        rows.append((i, f"{r.choice(['a@b.com', '+1 (555) 123-4567', '10.1.2.3', '4111111111111111', 'no'])} words {r.choice(said[kind]).format(yes)} more words {r.choice(bad)()} end"))
        spans.append((kind, yes))
    return rows, spans


def test_precision_and_recall_by_kind(spark):
    rows, spans = planted(4, 500)
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added, right, all_ = Counter(), Counter(), Counter(kind for kind, _ in spans)
    for row in found:
        for s in row["spans"]:
            if s not in row["base"]:
                kind = pii.KINDS[s["k"]]
                added[kind] += 1
                right[kind] += (kind, rows[row["doc_id"]][1][s["start"] : s["end"]]) == spans[row["doc_id"]]
    for kind in all_:
        assert right[kind] >= 0.95 * added[kind], (kind, right, added)
        assert right[kind] >= 0.9 * all_[kind], (kind, right, all_)


@pytest.mark.parametrize("text", ["std::vector", "12:30:45", "a::b", "C::D", "2024-01-02", "0.5-0.7", "1.000.000,00", "3:0", "face::off"])
def test_look_alikes_alone_are_left(spark, text):
    rows = [(1, f"it is {text} here"), (2, "call +1 (555) 123-4567"), (3, "mail a@b.com")]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first()
    assert found["spans"] == []
