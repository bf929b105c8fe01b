import math
import re
from collections import Counter

from critpath.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    best = None
    for _, rule in U.RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


URLS = [
    "http://a.example.com/en/1", "https://EXAMPLE.com/en/77?x=/de/", "http://example.net/de/81", "http://example.net/de/9#/en/", "x://net/de/", "http://xnet/de/1", "http://example.org/es/",
    "http://É.org/es/a", None, "", "no scheme", "a://b://c/d", "http://cheappills.example.org/fr/1", "http://goodbooks.example.com/fr/2", "http://", "http://h?q", "http://booksgood.net/de/5", "http://pillscheap.com/en/9",
]


def test_rules_and_parts(spark):
    html = "<p>cheap pills good books cheap pills good books good</p><script>noise</script>"
    rows = [(i, u, html if i % 2 else None, "x", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], html, "x", 1), (None, URLS[2], html, None, None)]
    got = U.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    verdict = {r: v for v, r in U.RULES}
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else URLS[2]
        host, path = brute_split(url)
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("block", "allow") and (rule is None or r.verdict == verdict[rule])
    by = {r.page_id: r for r in got}
    assert by[12].host_words == ["cheap", "pills", "example", "org"] and by[13].host_words == ["good", "books", "example", "com"]
    assert by[12].verdict == "block" and by[12].p_block > by[13].p_block


def test_viterbi_against_all_splits():
    counts = Counter({"a": 5, "ab": 40, "b": 3, "ba": 20, "bab": 9, "abc": 1})
    total = sum(counts.values())
    cost = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / (total * 10 ** len(w)))

    def splits(s):
        yield [s]
        for i in range(1, len(s)):
            for rest in splits(s[i:]):
                yield [s[:i], *rest]

    for name in ("a", "abab", "babab", "abcab", "zzabz", "ccc"):
        best = max(splits(name), key=lambda ws: sum(map(cost, ws)))
        assert math.isclose(sum(map(cost, U.viterbi(name, counts, total))), sum(map(cost, best)))


def test_bayes_against_plain_counts(spark):
    rows = [(i, f"http://s{'abc'[i % 3]}.example.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/{i}", None, None, None) for i in range(40)] + [(99, "http://sa.example.io/en/x", None, None, None)]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    n, t = Counter(), {"block": Counter(), "allow": Counter()}
    for r in got.values():
        if r.rule:
            n[r.verdict] += 1
            t[r.verdict].update(U.tokens(r.host_words, r.path))
    v = len({*t["block"], *t["allow"]})
    p = {y: math.log((n[y] + (0.5 if y == "block" else 1)) ) + sum(math.log((t[y][x] + 1) / (sum(t[y].values()) + v)) for x in U.tokens(got[99].host_words, got[99].path)) for y in t}
    assert math.isclose(got[99].p_block, 1 / (1 + math.exp(p["allow"] - p["block"])), rel_tol=1e-6)


def test_no_rows(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_memory_is_given_back_before_pages_are_read(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(U, "give_back", calls.append)
    monkeypatch.setattr(U.common, "table", lambda *_: calls.append("read"))
    monkeypatch.setattr(U, "judge", lambda pages: pages)
    U.op2_urls(spark, "")
    assert calls == [spark, "read"]
