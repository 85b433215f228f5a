"""The field of personal data: held-out precision and recall, whole texts, contract patterns."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from folioforge.llm import privacy


def plain_base(text):
    """The contract's patterns as they stand."""
    luhn = lambda d: sum(x - 9 * (x > 9) for x in (int(c) << (k & 1) for k, c in enumerate(reversed(d)))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}


@pytest.fixture(scope="module")
def texts():
    return [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]


def test_base_spans_are_the_patterns(texts):
    rng = np.random.default_rng(1)
    alphabet = list("0123456789" * 3 + "abAB@@..--++() \n%_é١")
    odd = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(4000)]
    for t in odd + texts + ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b.c@d.e"]:
        assert privacy.base_spans(t) == plain_base(t), t


def planted(texts, seed):
    """Values of formats that the training table lacks, put between words of real texts; and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    n = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    h = lambda k: "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, k))
    good = [lambda: ("secret", f'token = "{(v := h(40))}"', v), lambda: ("secret", f"password: {(v := 'Qx' + h(18) + 'Z7')}", v), lambda: ("secret", f"api_key = '{(v := 'sk' + h(22))}'", v), lambda: ("phone", (v := f"({n(3)}) {n(3)} {n(4)}"), v), lambda: ("phone", (v := f"{n(3)} {n(3)}-{n(4)}"), v), lambda: ("email", (v := f"anna.{h(3)}x (at) mailhost (dot) net"), v), lambda: ("email", (v := "kim [at] sub [dot] host [dot] org"), v)]
    bad = [lambda: f"revision {h(40)}", lambda: f"the token of {n(2)}", lambda: f"{n(4)}-0{n(1)}-{n(2)}", lambda: f"pages {n(3)}-{n(3)}", lambda: f"{n(2)}:{n(2)}:{n(2)}", lambda: f"ISBN {n(9)}"]
    out = []
    for t in texts:
        words = t.split(" ")
        at = int(rng.integers(0, len(words) + 1))
        kind, put, value = good[rng.integers(len(good))]()
        before, after = " ".join(words[:at]), " ".join(words[at:])
        whole = " ".join([before, bad[rng.integers(len(bad))](), "and some more words here", put, "then", after])
        where = whole.index(put) + put.index(value)
        out.append((whole, kind, (where, where + len(value))))
    return out


def test_added_spans_on_held_out_rows(texts):
    clean = [t for t in texts if not any(plain_base(t).values()) and "token" not in t]
    rows = planted(clean, 9)
    hit = wrong = 0
    for (_, kind, span), (base, every) in zip(rows, privacy.scan([r[0] for r in rows])):
        added = [(k, x) for k, v in every.items() for x in v if x not in base.get(k, [])]
        hit += (kind, span) in added or span in base.get(kind, [])
        wrong += sum(x != (kind, span) for x in added)
    recall, precision = hit / len(rows), hit / max(1, hit + wrong)
    print(f"precision {precision:.3f}, recall {recall:.3f} of {len(rows)}")
    assert recall >= 0.85 and precision >= 0.85


def test_clean_texts_get_no_span(texts):
    clean = [t for t in texts if not any(plain_base(t).values()) and "token" not in t]
    assert sum(any(every.values()) for _, every in privacy.scan(clean)) <= len(clean) // 50


def test_neighbourhoods_are_the_whole_text(texts):
    crf = privacy.field()
    for text, _, _ in planted(texts[:40], 3):
        text = text[:6000]
        words = [m.span() for m in privacy._WORD.finditer(text)]
        whole = crf.viterbi([[crf.feature(text[a:b]) for a, b in words]])[0]
        parts = dict.fromkeys(words, 0)
        segs = privacy.segments(text, 2 * privacy.SIDE)
        for seg, tags in zip(segs, crf.viterbi([[crf.feature(text[a:b]) for a, b in s] for s in segs])):
            parts.update(zip(seg, tags))
        assert [parts[w] for w in words] == whole


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "password = 'aB3dE6gH9kLmN0pQ'"), (4, "word " * 50000 + "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_email")
    got = {(r.doc_id, r.spans) for r in privacy.find(docs).collect()}
    assert got == {(1, ""), (2, ""), (3, ""), (None, "secret:12:28"), (4, "email:250000:250006")}
    assert privacy.find(docs).count() == 6 and privacy.find(docs.limit(0)).count() == 0
