"""The tree of path templates against a plain version on dictionaries."""

import re
from collections import Counter, defaultdict

import pytest

from tabletools.llm.queries import op6_url_filters
from tabletools.llm.url_filters import judge_urls

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def slow_name(segment):
    ending = r"(\.[A-Za-z][A-Za-z0-9]{0,4})?"
    for name, pattern in (("n", "[0-9]+"), ("d", r"[0-9]{4}[-_.][0-9]{2}[-_.][0-9]{2}"), ("h", "[0-9a-fA-F-]{8,}"),
                          ("s", r"[^-_]+([-_][^-_]+){2,}|[A-Za-z_-]*[0-9][A-Za-z0-9_-]*")):
        if re.fullmatch("(" + pattern + ")" + ending, segment):
            return "{" + name + "}" + (re.search(ending + "$", segment)[1] or "")
    return segment


def like_siblings(own, everything, after, others):
    """own, everything: [n, blocked, labelled]; after, others: what follows the branch and its siblings."""
    rest = [b - a for a, b in zip(own, everything)]
    if not rest[0]:
        return False
    if own[2] and rest[2]:
        p = everything[1] / everything[2]
        if (own[1] / own[2] - rest[1] / rest[2]) ** 2 > 1.96 ** 2 * p * (1 - p) * (1 / own[2] + 1 / rest[2]) + 1e-12:
            return False
    return sum(abs(after[x] / own[0] - others[x] / rest[0]) for x in {*after, *others}) / 2 <= 0.25 + 1e-12


def slow_templates(pooled):
    """{names: template}; pooled: {names: [n, blocked, labelled]}."""
    template, level = {names: () for names in pooled}, 0
    while open_ := [k for k in pooled if len(k) > level]:
        branches, after = defaultdict(lambda: [0, 0, 0]), defaultdict(Counter)
        for k in open_:
            at = template[k], k[level]
            branches[at] = [a + b for a, b in zip(branches[at], pooled[k])]
            after[at][k[level + 1] if len(k) > level + 1 else ""] += pooled[k][0]
        final = {}
        for (node, name), own in branches.items():
            siblings = [b for b in branches if b[0] == node]
            everything = [sum(branches[b][i] for b in siblings) for i in range(3)]
            others = sum((after[b] for b in siblings if b[1] != name), Counter())
            final[node, name] = "*" if like_siblings(own, everything, after[node, name], others) else name
        for k in open_:
            template[k] += (final[template[k], k[level]],)
        level += 1
    return template


def slow_judge(urls):
    """(host, path, rule, verdict, template, purity) of each address."""
    split = [slow_split(u) for u in urls]
    rules = [slow_rule(*s) for s in split]
    names = {s: tuple(slow_name(x) for x in s[1].split("/") if x) for s in split}
    pooled, nodes, leaves = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for s, r in zip(split, rules):
        for i, v in enumerate((1, r is not None and RULES[r] == "block", r is not None)):
            pooled[names[s]][i] += v
    template = slow_templates(pooled)
    for k, (_, blocked, labelled) in pooled.items():
        for i in range(1, len(template[k]) + 1):
            nodes[template[k][:i]] = [nodes[template[k][:i]][0] + blocked, nodes[template[k][:i]][1] + labelled]
    for s, r in zip(split, rules):
        leaf = leaves[s[0], template[names[s]]]
        leaf[0] += r is not None and RULES[r] == "block"
        leaf[1] += r is not None
    prior = (sum(v[1] for v in pooled.values()) + 1) / (sum(v[2] for v in pooled.values()) + 2)
    out = []
    for s, r in zip(split, rules):
        t, p = template[names[s]], prior
        for blocked, labelled in [nodes[t[:i]] for i in range(1, len(t) + 1)] + [leaves[s[0], t]]:
            p = (blocked + 2 * p) / (labelled + 2)
        out.append((*s, r, RULES[r] if r else "block" if p > 0.5 else "allow", "/" + "/".join(t), round(p, 9)))
    return out


def same(rows, urls):
    found = Counter((r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in rows)
    assert found == Counter(slow_judge(urls))


def judged(spark, urls):
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)).collect()
    same(rows, urls)
    return rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_version(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    rows = op6_url_filters(spark, f"/root/testdata/{sf}").collect()
    assert {r.page_id for r in rows} == {p.page_id for p in pages} and len(rows) == len(pages)
    same(rows, [p.url for p in pages])
    if sf == "sf0.001":                  # a few labels
        return
    unruled = [r for r in rows if not r.rule]
    assert {r.verdict for r in unruled if r.path.startswith("/es/")} == {"block"}      # as where rules judge them
    assert {r.verdict for r in unruled if r.path.startswith("/fr/")} == {"allow"}


@pytest.mark.parametrize("few,many", [(1, 5), (5, 400)])
def test_hosts_of_any_size_are_judged_alike(spark, few, many):
    labelled = [f"http://b.example.org/es/{i}" for i in range(30)] + [f"http://b.example.org/de/{i}" for i in range(60)]
    rows = judged(spark, labelled + [f"http://few.net/{d}/{i}" for d in ("es", "de") for i in range(few)]
                  + [f"http://many.net/{d}/{i}" for d in ("es", "de") for i in range(many)])
    for r in rows:
        if r.host.endswith(".net"):
            assert r.verdict == ("block" if r.path.startswith("/es/") else "allow"), r


def test_variable_segments_and_merged_branches(spark):
    urls = [f"https://a.org/shop/{i}.html" for i in range(20)] + [f"http://a.org/shop/2024-01-{i:02}/x" for i in range(10, 20)] \
        + [f"http://a.org/news/a-long-title-{i}" for i in range(9)] + [f"http://b.example.org/es/{i:08x}a" for i in range(30)] \
        + [f"http://x.com/de/{c}/{i}" for c in "pqr" for i in range(12)] + [f"http://y.net/de/{c}/{i}" for c in "pqrs" for i in range(2)]
    rows = judged(spark, urls)
    by = {r.host + r.path: r for r in rows}
    assert by["a.org/shop/3.html"].template.endswith("/{n}.html") and by["a.org/news/a-long-title-3"].template.endswith("/{s}")
    assert by["x.com/de/p/3"].template == by["y.net/de/q/1"].template == by["y.net/de/s/1"].template == "/de/*/{n}"
    assert by["y.net/de/s/1"].verdict == "block"


def test_nearest_node_with_labels_decides(spark):
    labelled = [f"http://x.com/de/shop/{i}" for i in range(20)] + [f"http://y.com/fr/{i}/a/b" for i in range(40)]
    rows = judged(spark, labelled + ["http://z.net/de/2024-01-02/0123abcdef.html", "http://z.net/fr/a/1", "http://z.net/it/1/q/w/e",
                                     "http://z.net/" + "a/7/" * 40, "http://z.net", None])
    by = {r.path: r.verdict for r in rows if r.host == "z.net"}
    assert by["/de/2024-01-02/0123abcdef.html"] == "block" and by["/fr/a/1"] == "allow"


def test_edges(spark):
    urls = [None, "", "no scheme/x", "://", "http://", "http://EXAMPLE.org", "http://example.org/ES/", "http://example.org/es/?a=/b",
            "http://notexample.org/es/1", "http://org/x", "http://com", "http://x.com/fr", "http://x.com/fr/#/y", "a://b://c/d",
            "http://h/" + "/".join("abcdefghijklmnop"), "http://h/" + "long" * 50_000, "http://h//a///b/", "http://é.org/ü", "http://h/a?b#c",
            "http://h#/a", "http://h?/a", "line\nhttp://h/b"]
    urls += urls[5:8] * 3
    table = spark.createDataFrame([(None if i == 3 else i, u, "x", 1, 2) for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, labelled int, n int")
    rows = judge_urls(table).collect()
    assert len(rows) == len(urls)
    same(rows, urls)
    assert judge_urls(table.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_joins_by_shuffle_give_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr("tabletools.functions.joins.BROADCAST_ROWS", -1)
    monkeypatch.setattr("tabletools.functions.joins.HOT_ROWS", hot)
    monkeypatch.setattr("tabletools.functions.joins.SALTS", 4)
    judged(spark, [f"http://b.example.org/es/{i}" for i in range(12)] + ["http://few.net/es/2076", "http://few.net/"] + [None] * 5)
