"""Operator 7: exact base against a plain scan, fuzzy finds against edit distance."""

import random
import re

from petrichor.llm import license_scan as L


def plain_base(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in L.BASE for i in range(len(w)) if w[i: i + len(phrase.split())] == phrase.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_base_on_made_up_texts():
    rng = random.Random(5)
    s = L.Scanner()
    parts = ["cc", "by", "CC-BY", "general", "public", "License", "all rights", "reserved", "É", "x1", ",", "\n", "all"]
    for _ in range(400):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert s.scan(t.encode())[:5] == plain_base(t)


def test_every_notice_with_few_edits_is_found():
    rng = random.Random(6)
    s = L.Scanner()
    for notice, label, errors in L.NOTICES:
        for _ in range(8):
            t = list(notice)
            for _ in range(errors):
                k = rng.randrange(len(t))
                rng.choice([lambda: t.__setitem__(k, "#"), lambda: t.__delitem__(k), lambda: t.insert(k, "#")])()
            text = "so it was. " + "".join(t) + " and on"
            found = s.fuzzy(L.flat(text.lower()))
            assert label in {x[2] for x in found}
            for a, b, got, edits in found:
                assert any(distance(L.flat(text.lower())[a:b], n) <= e for n, lab, e in L.NOTICES if lab == got)


def test_damaged_copies_close_together_are_all_found():
    s = L.Scanner()
    text = "mozila public license xx mozilla public license yy mozilla publik license"
    assert [x[3] for x in s.fuzzy(text) if x[2] == "mpl"] == [1, 0, 1]
    rng = random.Random(9)
    for notice, label, errors in L.NOTICES:
        for _ in range(4):
            text, places = "", []
            for _ in range(5):
                t = list(notice)
                for k in rng.sample(range(3, len(t) - 3), rng.randint(0, errors)):
                    t[k] = "#"
                places.append((len(text), len(text) + len(t)))
                text += "".join(t) + rng.choice([" xx ", " so. ", " and then "])
            found = [(a, b) for a, b, got, _ in s.fuzzy(text) if got == label]
            assert all(any(a < hi and lo < b for a, b in found) for lo, hi in places), text


def test_clean_text_has_no_label():
    assert L.Scanner().scan(b"The licence of poets is not a matter of rights, and the public knows it.")[5] == ""


def test_rows(docs, empty):
    out = L.scan(docs).collect()
    assert len(out) == docs.count() and L.scan(empty).count() == 0
    for r in out:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0)


def test_long_repetitive_text_takes_time_in_proportion():
    """Twenty times the text may take some thirty times as long at most; all places are found."""
    import time
    s, took = L.Scanner(), []
    for n in (2000, 40000):
        text = "all rigts reserved " * n + "all rights"
        began = time.perf_counter()
        found = s.fuzzy(text)
        took.append(time.perf_counter() - began)
        assert [x[:2] for x in found if x[2] == "reserved"] == [(19 * i, 19 * i + 18) for i in range(n)]
    assert took[1] < 30 * took[0] + 0.5


def test_several_hundred_notices(spark):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfklm" for b in "aeiou" for c in ("rst", "nd", "x", "lm")]
    notices = tuple((" ".join(rng.sample(words, 6)), f"n{k}", 2) for k in range(400))
    rows = [(k, "Some words before. " + notices[k][0][:7] + "#" + notices[k][0][8:] + " and some after.", "") for k in range(0, 400, 7)]
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string"), notices=notices).collect()
    assert all(r.labels.split(",") == [f"n{r.doc_id}"] for r in out)
