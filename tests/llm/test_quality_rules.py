import re
from collections import Counter

from thermoline.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for x in lines:
        dup_lines += x in seen
        dup_line_chars += len(x) * (x in seen)
        seen.add(x)
    three = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    repeat = {k + d for k in range(n - 2) if three[tuple(words[k : k + 3])] > 1 for d in range(3)}
    out = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup_lines, "n_repeat_words": len(repeat), "n_lines": len(lines), "line_chars": sum(map(len, lines)), "dup_line_chars": dup_line_chars}
    bad = 100 * dup_line_chars > 20 * out["line_chars"] or 100 * dup_lines > 30 * len(lines)
    for m, most in q.NGRAM_PERCENT.items():
        before, cover = set(), set()
        for k in range(n - m + 1):
            gram = tuple(words[k : k + m])
            if gram in before:
                cover |= set(range(k, k + m))
            before.add(gram)
        out[f"dup{m}_chars"] = sum(len(words[k]) for k in cover)
        bad |= 100 * out[f"dup{m}_chars"] > most * out["word_chars"]
    for m, most in q.TOP_PERCENT.items():
        grams = Counter(tuple(words[k : k + m]) for k in range(n - m + 1))
        out[f"top{m}_chars"] = max((x * sum(map(len, g)) for g, x in grams.items() if x > 1), default=0)
        bad |= 100 * out[f"top{m}_chars"] > most * out["word_chars"]
    out["base_failed"] = n < 50 or 100 * len(repeat) > 50 * n
    out["kept"] = not out["base_failed"] and not bad
    return out


def same(got, rows):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], sorted(r.items(), key=str))
    want = sorted(({"doc_id": i} | brute(t) for i, t in rows), key=lambda r: str(sorted(r.items())))
    assert sorted((r.asDict() for r in got), key=lambda r: str(sorted(r.items()))) == want, key


def test_matches_brute_force(real):
    same(q.quality_rules(real).collect(), [(r.doc_id, r.text) for r in real.collect()])


def test_odd_rows(table, odd):
    same(q.quality_rules(table(odd)).collect(), odd)


def test_empty_table(table):
    assert q.quality_rules(table([])).count() == 0


def test_stage_keeps_whole_rows(table, odd):
    docs = table([*odd, (9, " ".join(f"w{k}" for k in range(80)))])
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [9]


def test_repeated_passage_is_rejected(table):
    once = " ".join(f"w{k}" for k in range(60))
    assert [r.kept for r in q.quality_rules(table([(1, once), (2, f"{once}\n{once} extra")])).orderBy("doc_id").collect()] == [True, False]


def test_published_limits(table):
    """A 12-word phrase 16 times in a text of 1000 words of equal length covers 18 percent: over the limit of 10-word repeats."""
    phrase = " ".join(f"p{k:03}" for k in range(12))
    text = " ".join(" ".join(f"{chr(97 + k)}{j:03}" for j in range(50)) + " " + phrase for k in range(16))
    (r,) = q.quality_rules(table([(1, text)])).collect()
    assert 0.16 < r.dup10_chars / r.word_chars < 0.2 and not r.base_failed and not r.kept


def test_most_frequent_gram(table):
    text = " ".join(f"longword secondword u{k:02}" for k in range(30))
    (r,) = q.quality_rules(table([(1, text)])).collect()
    assert r.top2_chars == 30 * len("longwordsecondword") and not r.kept
