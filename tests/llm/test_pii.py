import hashlib
import random
import re

from odd import ODD_TEXTS

from rootscope.llm.pii import KINDS, SpanClassifier, find_personal_data, reliabilities

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])] for k in KINDS}


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def test_base_spans_against_brute_force(docs):
    rng = random.Random(7)
    parts = [
        "a.b@c.de", "x@y", "@z.co", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112",
        "378282246310005", "+49 (30) 123-4567", "+1 2", "+12345678901234567", "+1.2.3.4", "é", "😀", " ", " ", "-", ".", "+", "7", "00", "tel ", "(at)", "%", "_",
    ]
    texts = [*ODD_TEXTS, "4" * 5000, "+1" + "1 " * 4000, "a" * 30000 + "@", ("1." * 6000), "a@" * 3000, "x@y.z " * 500]
    texts += ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(800)]
    rows = list(enumerate(texts))
    got = find_personal_data(docs(rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "b_email")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [len(want[k]) for k in KINDS], texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


def test_spans_are_added_in_order_and_clean_texts_left_alone(docs):
    rows = [f"mail me at john{i}@example.com or call +1 (212) 555-01{i:02d} now" for i in range(40)]
    rows += [f"please call my phone (212) 555-01{i:02d}" for i in range(20)]
    rows += [f"write an e-mail to john{i} [at] example [dot] com" for i in range(20)]
    rows += [f"order number 48123456789012{i:02d} shipped, build 212-555-01{i:02d} of version" for i in range(40)]
    got = {r.doc_id: r for r in find_personal_data(docs(rows)).collect()}
    assert got[0].n_email == got[0].n_phone == 1 and [s.split(":")[0] for s in got[0].spans.split(",")] == ["email", "phone"]
    assert all(got[i].spans.startswith("phone:21:") and got[i].n_phone == 0 for i in range(40, 60))
    assert all(got[i].spans.startswith("email:19:") for i in range(60, 80))


def test_reliabilities_follow_agreement():
    good, bad = (1, 1, 1, 1, 0), (0, -1, -1, 0, -1)
    p = reliabilities({("card", good): 100.0, ("card", bad): 300.0, ("card", (0, 1, 1, 0, 0)): 5.0})
    assert p[("card", good)] > 0.9 > 0.1 > p[("card", bad)]
    assert SpanClassifier.fit({}).kinds.keys() == set(KINDS)


def test_none_and_unknown_ids(docs):
    assert find_personal_data(docs([])).count() == 0
    got = find_personal_data(docs([(None, "a@b.cd"), (1, None), (1, None)])).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in got) == [("1", 0, ""), ("1", 0, ""), ("None", 1, "email:0:6")]
