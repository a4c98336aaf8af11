import hashlib
import re
import time

import numpy as np
import pyarrow as pa

from thermoline.llm import pii


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def base(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t else "")]  # slow on a long run without
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def check(docs, rows):
    got = pii.personal_spans(docs).collect()
    want = []
    for i, t in rows:
        b = base(t)
        want.append((i, *(sum(x[0] == k for x in b) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    return got


ODD = ["a@b.c", "x@y", "a@@b.c a@b..c", "a.b%c+d-e@f-g.h.i.j@k.l", "é@b.c ü.x@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111x", "41111111111111112", "+1 (459) 555-9246", "+1(((((((((((( +4930", "+123456789012345678", "\U0001f600 +49 30 1234567 a@b.de", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "9" * 5_000, "a@b." + "c" * 3_000, "@" * 5000, "1." * 20_000, "x (at) y " + "a" * 3_000, "ann (at) web (dot) org [at] b.c"]


def test_matches_brute_force(real):
    check(real, [(r.doc_id, r.text) for r in real.collect()])


def test_odd_rows(table, odd):
    rows = [*odd, *enumerate(ODD, 100), (101, ODD[0])]
    for r in check(table(rows), rows):
        kinds = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert [(pii.KINDS.index(k), int(s)) for k, s, _ in kinds] == sorted((pii.KINDS.index(k), int(s)) for k, s, _ in kinds)
    assert pii.personal_spans(table([])).count() == 0


def test_random_texts_match_the_patterns():
    rng = np.random.default_rng(1)
    for chars in ("a1.@-", "0123.", "12 -", "+1 (.)-", "a1.@- +()_é"):
        for _ in range(1500):
            t = "".join(rng.choice(list(chars), rng.integers(0, 60)))
            assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == base(t), t


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7])
    votes = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]) * 2
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    p, table = pii.reliabilities(patterns, count.astype(float))
    assert np.abs(table[1, :, 2] - right).max() < 0.04
    assert abs((p * count).sum() / count.sum() - 0.3) < 0.03


def test_wider_spans_are_added(table):
    rows = [(k, f"please call phone (459) 555-{1000 + k} or contact mail ann{k}@web.org") for k in range(40)] + [(90, "build 1234567890123 of the part")]
    got = {r.doc_id: r for r in check(table(rows), rows)}
    assert all("phone:18:32" in got[k].spans for k in range(40))
    assert got[90].spans == ""


def test_mask(table, odd):
    docs = table([*odd, (50, "mail a@b.org, ip 1.2.3.4 card 4111111111111111 tel +1 (459) 555-9246.")])
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    (r,) = out.where("doc_id = 50").collect()
    assert r.text == "mail [EMAIL], ip [IP] card [CARD] tel [PHONE]." and r.n_chars == len(r.text)


def test_long_texts_take_time_in_proportion():
    for text in ("x (at) y " + "a" * 1_000_000, "(at)" * 250_000, "9" * 50_000, "a@b." + "c" * 20_000, "a(at)b" * 150_000, "4111 1111 1111 1111 " * 4000 + "(459) 555-1234 " * 4000, "Anna " * 50_000):
        began = time.time()
        pii.candidates(text)
        assert time.time() - began < 3, text[:30]


def test_proposals_that_meet_are_one():
    spans = [(s, e) for _, s, e, *_ in pii.candidates("tel 459-555-1234 567 or (459) 555-9246 and 1234 5678 9012 34 mail ann (at) web (dot) org")]
    assert len(spans) >= 3
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_the_classifier_adds_to_the_votes():
    """Weak labelers, and words beside the spans that none of them looks at: the classifier is right more often than its soft labels."""
    rng = np.random.default_rng(9)
    n, right = 6000, np.array([0.8, 0.75, 0.75, 0.7, 0.7])
    truth = rng.random(n) < 0.4
    votes = np.where(rng.random((n, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    codes = np.array([sum((v + 1) * 3 ** (4 - k) for k, v in enumerate(row)) + 3 * 3**5 for row in votes])
    word = np.where(rng.random(n) < 0.9, truth, ~truth)
    texts = [f"{'ring' if w else 'crate'} 459-555-0000" for w in word]
    cells = [pii._cells(t, 3, len(t) - 12, len(t)) for t in texts]
    distinct, count = np.unique(codes, return_counts=True)
    judge = pii.Judge(distinct, count, [(c, x, 1.0) for c, x in zip(codes.tolist(), cells, strict=True)])
    soft = pii.posteriors(distinct, count)
    got = judge.scores(codes, pa.array(cells, pa.list_(pa.int32())))
    by_votes, by_judge = ((np.asarray(x) >= 0.5) == truth for x in ([soft[c] for c in codes.tolist()], got))
    print(by_votes.mean(), by_judge.mean())
    assert by_judge.mean() > by_votes.mean() + 0.03
