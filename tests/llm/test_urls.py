import random
import re

import numpy as np
import pyarrow as pa

from topicloom.llm import op13_urls as op


def plain(glob, text):
    """The glob by dynamic programming over what is left of both."""
    if not glob:
        return not text
    if glob.startswith(b"**"):
        return any(plain(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob.startswith(b"*"):
        stop = text.find(b"/")
        return any(plain(glob[1:], text[i:]) for i in range((len(text) if stop < 0 else stop) + 1))
    return text[:1] == glob[:1] and plain(glob[1:], text[1:])


def test_automaton_against_plain_matching():
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("ab/.") for _ in range(n))
    globs = ["", "*", "**", "***", "a*", "*a**b", "é*", *["".join(rng.choice([piece(3), "*", "**"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)], "x" * 70 + "*y"]
    texts = ["", "/", "é/", "éa", "x" * 70 + "zy", *[piece(rng.randrange(9)) for _ in range(150)]]
    column = pa.array(texts, pa.large_string())
    _, offsets, data = column.buffers()
    got = op.Automaton(globs).fits(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [plain(g.encode(), t.encode()) for g in globs], t


def judged(url):
    """The contract, in plain Python."""
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for v, h, p in op.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_rules_by_contract(spark):
    urls = [
        None, "", "no address", "://", "http://", "HTTP://WWW.Example.COM/en/x?q=://b.com/", "http://example.com/en/", "http://example.com/en", "http://a.b.example.com/en/1#t", "http://www.example.com/en/1", "http://x.www.example.com/en/1",
        "http://notexample.com/en/1", "http://com", "http://com/", "http://com?/", "http://a.net/es/", "http://net/fr/x", "http://net/de/", "https://user@a.com:80/x", "http://a.com:80", "http://evil.org/x.com/y", "http://É.com/É", "x://y://z.com/", "http://a.com/\n/b",
        "http://farm.spam-1.org/x", "http://a.m.b.org/de/1.html", "http://a.m.b.org/en/1.html", "http://a.org/x.exe", "http://a.net/" + "é/" * 20_000, "http://a.org/login/",
    ]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(5, urls[5], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = op.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    by = {r["page_id"]: (r["own_rule"], r["verdict"]) for r in got}
    assert by[0] == by[2] == (".", "block") and by[24] == ("*.spam-*.**", "block") and by[26] == ("*.m.*.org/en/**", "allow") and by[17] == (None, op.DEFAULT)
    assert op.judge(pages.limit(0)).count() == 0
