import re

from motifgrid.llm.urlfilter import RULES, TemplateTree, filter_urls, op10_url_filters

from .oracle import assert_same


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


URLS = [
    None, "", "nothing", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "http://borg/x", "http://example.org/es/1", "http://m.example.org/es/", "http://example.org/en/1",
    "http://example.org/en/12?q#f", "http://example.org/en/2", "http://xexample.org/es/1", "http://a.com/fr/1", "http://a.com/de/1", "http://a.com/fr", "http://com/de/", "http://a.com?x=/de/",
    "http://a.com#/de/", "http://É.COM/de/É", "x://y://org/a", "http://a.com/de/\n/x", "http://a.net//b//c", "http://a.net/1/2/3/4/5/6/7/8/9/10", "://org/x",
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in filter_urls(frame).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        assert found[i]["verdict"] == verdict if rule else found[i]["verdict"] in ("allow", "block")


def plain(rows, tree):
    """The method for rows (host, segments, good), with loops."""
    node = [""] * len(rows)
    for level in range(max((len(s) for _, s, _ in rows), default=0)):
        groups = {}
        for k, (h, s, g) in enumerate(rows):
            if len(s) > level:
                groups.setdefault((h, node[k]), {}).setdefault(s[level], []).append(k)
        for (_, at), children in groups.items():
            own = [k for c in children.values() for k in c]
            seen = sum(rows[k][2] is not None for k in own)
            share = (sum(rows[k][2] or 0 for k in own) + 1) / (seen + 2)
            for name, members in children.items():
                n = sum(rows[k][2] is not None for k in members)
                good = sum(rows[k][2] or 0 for k in members)
                many = len(children) > tree.fan_out and len(members) < tree.rare * len(own)
                alike = abs((good + share) / (n + 1) - share) <= (tree.strict if many else tree.z) * (share * (1 - share) / max(n, 1)) ** 0.5
                for k in members:
                    node[k] = f"{at}/{'*' if len(children) > 1 and alike else name}"
    labels = [g for _, _, g in rows if g is not None]
    of_all = (sum(labels) + 1) / (len(labels) + 1)
    out = []
    for k, (h, s, _) in enumerate(rows):
        mine = [g for (h2, _, g) in rows if h2 == h and g is not None]
        of_host = (sum(mine) + tree.strength * of_all) / (len(mine) + tree.strength)
        same = [g for j, (h2, _, g) in enumerate(rows) if h2 == h and node[j] == node[k] and g is not None]
        purity = (sum(same) + tree.strength * of_host) / (len(same) + tree.strength)
        out.append((node[k] or "/", purity, "block" if purity < tree.threshold else "allow"))
    return out


def test_templates_against_loops(spark):
    rows = []
    for i in range(240):
        section = ("news", "spam", "shop", "old")[i % 4]
        path = f"/{section}/{i}" if i % 3 else f"/{section}/item{i % 40}/x/{'y/' * (i % 11)}"
        good = None if i % 5 == 0 else int(section != "spam")
        rows.append((i, f"http://h{i % 2}.net{path}", good))
    rows += [(500 + i, f"http://h1.net/doc/{'0a1b2c3d' if i % 2 else 'deadbeef'}-{i:04x}", i % 2) for i in range(10)]
    rows += [(1000 + i, f"http://big.net/u{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}/p", 1 if i % 7 else 0) for i in range(100)]
    # One bad section among many small ones keeps its own verdict.
    rows += [(2000 + i, f"http://wide.net/{chr(97 + i % 25) * 3}/p" if i % 40 else "http://wide.net/bad/p", int(i % 40 > 0)) for i in range(4000)]
    rows.append((9000, "http://h1.net/" + "/".join("abcdefghijklmnopqrstuvwxyz"), 1))
    tree = TemplateTree()
    frame = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if g is not None], "page_id long, good int")
    found = {r["page_id"]: r for r in filter_urls(frame, (), tree, labels).collect()}

    def lex(url):
        own = [s for s in parts(url)[1].split("/") if s]
        return ["{h}" if re.fullmatch("[0-9a-f-]{8,}", s) and re.search("[0-9]", s) else re.sub("[0-9]+", "{n}", s) for s in own]

    expected = plain([(parts(u)[0], lex(u), g) for _, u, g in rows], tree)
    for (i, _, _), (template, purity, verdict) in zip(rows, expected, strict=True):
        assert (found[i]["template"], found[i]["verdict"]) == (template, verdict) and abs(found[i]["purity"] - purity) < 1e-9
    assert {(r["template"], r["verdict"]) for r in found.values() if r["path"] == "/bad/p"} == {("/bad/p", "block")}
    assert {r["verdict"] for i, r in found.items() if "/spam/" in rows[min(i, 239)][1] and i < 240} == {"block"}


def test_the_query_equals_its_sql(spark):
    assert_same(spark, "/root/testdata/sf0.001", "op10_url_filters")


def test_repeated_labels_multiply_no_page(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.net/y")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (2, 1)], "page_id long, good int")
    found = filter_urls(pages, (), labels=labels).collect()
    assert sorted(r["page_id"] for r in found) == [1, 2]


def test_empty_and_repeated(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    assert op10_url_filters(spark, str(tmp_path)).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/x")] * 3 + [(None, "http://a.net/x")], "page_id long, url string")
    found = filter_urls(twice).collect()
    assert len(found) == 4 and {r["verdict"] for r in found} == {"allow"}
