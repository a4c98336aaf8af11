import fnmatch
import random
import re

import duckdb
import numpy as np

from thermoline.llm import url_filter as u
from thermoline.llm.queries import oracle_sql


def as_regex(glob):
    return re.compile("".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.findall(r"\*\*|\*|[^*]+", glob)), re.S)


def test_automaton_matches_regular_expressions():
    rng = random.Random(5)
    word = lambda n, chars: "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))
    globs = ["", "*", "**", "a", "***"] + [word(9, "ab/.**") for _ in range(120)]
    texts = ["", "/", "a"] + [word(14, "ab/.") for _ in range(300)]
    raw = [t.encode() for t in texts]
    got = u.GlobAutomaton(globs).match(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = np.array([[bool(as_regex(g).fullmatch(t)) for g in globs] for t in texts])
    assert (got == want).all()
    assert fnmatch.fnmatch("ads-x.org/en/1", "ads-*/*")


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in u.RULES:
        if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(f"/{r.path}") and (best is None or len(r.name) > len(best.name)):
            best = r
    bad = any(as_regex(g).fullmatch(host + path) for g in u.BLOCK_GLOBS)
    return host, path, best and best.name, best.action if best else "block" if bad else "allow"


def test_query_matches_brute_force(spark):
    odd = [None, "", "no scheme/en/", "http://", "HTTP://EXAMPLE.COM/en/7", "x://Com/en/", "x://acom/en/", "x://a.com?/en/", "x://a.com/en", "x://a.net/de/8", "x://example.net/de/81?q", "x://É.Org/es/a://b", "x://evil.org/x.com/en/", "x://ads-a.org", "x://b.ads-a.org/p#f", "x://a.b\n.com/en/\n", "x://a.com/en/" + "y" * 50_000, "http://.com/en/"]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url) for r in pages.collect()] + list(enumerate(odd, 10_000)) + [(10_001, ""), (None, "x://b.net/de/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS canonical")
    got = u.url_verdicts(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(x)) for i, x in rows), key=str)
    assert u.url_verdicts(df.limit(0)).count() == 0
    with duckdb.connect() as db:
        db.register("pages", df.toPandas()[["page_id", "url"]].astype({"page_id": "Int64"}))
        want = db.sql(oracle_sql()["op2_glob_automaton"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_thousands_of_globs(spark):
    rng = random.Random(17)
    words = ["ads", "track", "shop", "news", "cdn", "img", "blog", "click"]
    globs = tuple(f"*.{rng.choice(words)}{rng.randint(0, 999)}.{rng.choice(('com', 'net'))}/{rng.choice(('', '**', 'a/**', '*/x'))}" for _ in range(3000))
    assert u.GlobAutomaton(list(globs)).words > 500
    urls = [f"https://w.{rng.choice(words)}{rng.randint(0, 999)}.{rng.choice(('com', 'net'))}/{rng.choice(('', 'a/b', 'q/x', 'x'))}" for _ in range(400)]
    got = {r.page_id: r.verdict for r in u.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=(), block_globs=globs).collect()}
    known = [as_regex(g) for g in globs]
    want = {k: "block" if any(g.fullmatch(x.split("://")[1]) for g in known) else "allow" for k, x in enumerate(urls)}
    assert got == want and set(want.values()) == {"allow", "block"}
