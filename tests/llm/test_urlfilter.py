import random
import re

import pytest

from slotvalue.llm import urlfilter as U

SCHEMA = "page_id long, url string, target string, key string, rule string, verdict string, host string"
A_Z = {i: i + 32 for i in range(65, 91)}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(A_Z), re.match(r"[^?#]*", rest[len(host):])[0]


def glob(pattern):
    """A pattern read character by character, its own way."""
    body = pattern
    head = ""
    if body.startswith("||"):
        head, body = r"^([^/]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    tail = ""
    if body.endswith("|"):
        tail, body = r"\Z", body[:-1]
    mid = "".join({"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    return re.compile(head + mid + tail, re.S)


def brute(url, hosts, patterns):
    host, path = split(url)
    found = [(1, len(h + p), a == "block", h + p, a) for h, p, a in hosts
             if None not in (h, p, a) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    found += [(0, len(p), a == "block", p, a) for p, a in patterns
              if None not in (p, a) and glob(p).search(host + path)]
    best = max(found) if found else None
    return host, path, best[3] if best else None, best[4] if best else "allow"


def run(spark, urls, hosts, patterns):
    pages = spark.createDataFrame([(n, u, "x", "y", "z", "w", "h") for n, u in urls], SCHEMA)
    rules = U.host_rules(U.literal_table(spark, hosts, {"host": "string", "path": "string", "action": "string"})).union(
        U.pattern_rules(U.literal_table(spark, patterns, {"pattern": "string", "action": "string"})))
    return U.judge(pages, rules)


URLS = ["https://Example.ORG/es/1", "http://www.example.org/en/12?x=1", "http://example.org/en/2", "http://a.org/", "http://org/x",
        "http://org", "http://xorg/", "http://a.com/fr/", "http://a.com/FR/", "http://b.a.com/de/#x", "http://a.com/fr?y",
        "http://a.com", "a.com/fr/", "", None, "://", "http://?q", "x://y://z.com/fr/", "http://example.org:80/es/",
        "http://a.org/\n/es/", "http://Ünï.com/fr/ü", "http://a.com/fr/" + "ab/" * 20_000, "http://a.com//fr/", "HTTP://A.Com/de/Ä"]


def test_contract_rules_and_odd_urls(spark):
    rows = [(n, u) for n, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1]), (None, None)]
    got = run(spark, rows, U.HOST_RULES, []).collect()
    want = [(n, u, *brute(u, U.HOST_RULES, [])) for n, u in rows]
    key = repr
    assert sorted([(r.id, r.url, r.host, r.path, r.rule, r.verdict) for r in got], key=key) == sorted(want, key=key)


PATTERNS = ["*", "ab*", "||b.a^", "|a.b/", "b/a|", "a^b", "*a*b*", "||a.b/a", "a.b", "(a)", "a|b", "|a|", "bab", "||ab.a^*b", "", "|", "||",
            "^", "abc", "ab/abc", "c-a", "a$b", "a\\b", "||c*/b|"]


@pytest.mark.parametrize("seed", range(4))
def test_any_patterns(spark, seed):
    rng = random.Random(seed)
    urls = ["http://" + "".join(rng.choice("aaabbbcc..//-") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    urls += ["http://a|b/(a)", "http://a$b", "http://x/a\\b"]
    rng.shuffle(PATTERNS)
    patterns = [(p, rng.choice(["allow", "block", "hold"])) for p in PATTERNS[:rng.randrange(1, len(PATTERNS))]]
    hosts = [("b.a", "", "block"), ("a", "/b", "allow"), ("a", "/*", "block"), (None, "/", "block"), ("c", None, "block")]
    got = run(spark, list(enumerate(urls)), hosts, patterns + [(None, "block"), ("a", None)]).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(r.url)
        found = [(1, len(h + p), a == "block", h + p, a) for h, p, a in hosts if None not in (h, p)
                 and (host == h or host.endswith("." + h)) and (path == "" or path.startswith("/") if p == "" else path.startswith(p))]
        found += [(0, len(p), a == "block", p, a) for p, a in patterns if glob(p).search(host + path)]
        best = max(found) if found else (None, None, None, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[3], best[4]), r.url


def test_filed_under_the_rarest_whole_token(spark):
    rules = U.host_rules(U.literal_table(spark, U.HOST_RULES, {"host": "string", "path": "string", "action": "string"}))
    keys = {r.rule: set(r["keys"]) for r in rules.collect()}
    assert keys["example.org/en/1"] == {"texample", "torg", "ten"}  # "1" may go on
    wild = U.pattern_rules(U.literal_table(spark, [("*cheap-pills*", "block"), ("ab*c", "block")],
                                           {"pattern": "string", "action": "string"}))
    keys = {r.rule: set(r["keys"]) for r in wild.collect()}
    assert {"pche", "pp-p", "plls"} <= keys["*cheap-pills*"] and keys["ab*c"] == {""}


def test_no_rules_no_pages(spark):
    assert {(r.rule, r.verdict) for r in run(spark, [(1, URLS[0])], [], []).collect()} == {(None, "allow")}
    pages = spark.createDataFrame([], SCHEMA)
    rules = U.host_rules(U.literal_table(spark, U.HOST_RULES, {"host": "string", "path": "string", "action": "string"}))
    assert U.judge(pages, rules).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    run(spark, [(1, URLS[0])], U.HOST_RULES, [("*x*", "block")]).explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonRDD", "")
