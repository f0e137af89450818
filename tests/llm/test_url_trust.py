import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import floor
from urllib.parse import urlsplit

from panelweave.llm import url_trust
from panelweave.llm.queries import URL_RULES


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)


PAGES = [
    (1, "https://WWW.Good.org/a?b=1", link("friend.net", "friend.net", "other.net")),
    (2, "http://friend.net/", link("third.net")),
    (3, "http://third.net", link("spam.net") + '<img src="//x.y/z"><a href="/local">'),
    (4, "https://x.example.org/es/1", link("spam.net")),
    (5, "http://spam.net/p#q://z", link("x.example.org", "spam.net")),
    (6, "http://farm.net/?u=http://good.org/", link("x.example.org", "spam.net")),
    (7, "https://x.example.org/en/12", None),
    (7, "https://x.example.org/en/12", None),
    (8, "https://x.example.org/en/2", ""),
    (9, None, link("good.org")),
    (10, "no scheme", link("good.org")),
    (11, "mailto://", ""),
    (None, "http://shop.com/fr/x", link("shop.com")),
    (12, "http://shop.com/de/x", link("SHOP.COM", "friend.net")),
    (13, "http://xcom/fr/", ""),
    (14, "http://Ärger.COM/fr", ""),
    (15, "http://example.org", ""),
]


def frame(spark, pages=PAGES):
    rows = [(*p, "mine", 1) for p in pages]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, mass int")


def brute(pages):
    """Plain rounds of whole-number mass."""

    def cut(url):
        rest = (url or "").split("://", 1)
        if len(rest) < 2:
            return "", ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest[1])[0])
        return host, re.split(r"[?#]", rest[1][len(host) :])[0] if rest[1][len(host) : len(host) + 1] == "/" else ""

    def rule(host, path):
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    places = [cut(u) for _, u, _ in pages]
    rules = [rule(*p) for p in places]
    edges = Counter()
    for (a, _), (_, _, html) in zip(places, pages, strict=True):
        for found in re.findall(r'(?:href|src)="([^"]*://[^"]*)"', html or ""):
            b = cut(found)[0]
            if a and b and a != b:
                edges[a, b] += 1
    scores = {}
    for kind, verdict, ways in (("t", "allow", edges), ("d", "block", {(b, a): n for (a, b), n in edges.items()})):
        seeds = Counter(p[0] for p, r in zip(places, rules, strict=True) if r and r.verdict == verdict and p[0])
        out = Counter()
        for (a, _), n in ways.items():
            out[a] += n
        start = {h: floor(url_trust.UNIT * n / max(1, sum(seeds.values()))) for h, n in seeds.items()}
        mass = dict(start)
        for _ in range(url_trust.ITERATIONS):
            new = defaultdict(int, {h: floor(m * (1 - url_trust.DAMPING)) for h, m in start.items()})
            for (a, b), n in ways.items():
                if a in mass:
                    new[b] += floor(mass[a] * (url_trust.DAMPING * n / out[a]))
            mass = new
        scores[kind] = mass
    rows = []
    for (ident, _, _), (host, path), r in zip(pages, places, rules, strict=True):
        t, d = scores["t"].get(host, 0), scores["d"].get(host, 0)
        verdict = r.verdict if r else "block" if d > 0 and d >= 0.5 * (t + d) else "allow"
        rows.append((ident, host, path, r.text if r else None, verdict, t, d))
    return sorted(rows, key=str)


def test_matches_brute_force(spark):
    found = url_trust.judge(frame(spark), URL_RULES)
    assert sorted(map(tuple, found.collect()), key=str) == brute(PAGES)


def test_trust_and_distrust_travel(spark):
    verdicts = {r.page_id: r for r in url_trust.judge(frame(spark), URL_RULES).collect()}
    assert verdicts[2].verdict == "allow" and verdicts[2].host_trust > 0
    # Hosts that link to blocked pages gain distrust, also over two links; nobody trusted links to the farm.
    assert verdicts[5].host_distrust > 0 and verdicts[3].host_distrust > 0
    assert verdicts[6].verdict == "block" and verdicts[6].host_trust == 0
    assert verdicts[9].verdict == "allow" and verdicts[9].host == ""


def test_no_rules_no_links_no_rows(spark):
    assert {r.verdict for r in url_trust.judge(frame(spark), ()).collect()} == {"allow"}
    assert url_trust.judge(frame(spark, []), URL_RULES).count() == 0


def test_plan_has_no_python(spark):
    plan = url_trust.judge(frame(spark), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_host(spark):
    pages = [(i, "http://hub.net/p" if i % 3 == 0 else f"http://h{i % 50}.net/", link(f"h{i % 40}.net", "good.org")) for i in range(1500)]
    pages.append((9999, "http://good.org/", link("hub.net")))
    assert sorted(map(tuple, url_trust.judge(frame(spark, pages), URL_RULES).collect()), key=str) == brute(pages)


def test_hosts_of_very_many_ruled_pages(spark):
    # 2^50 units times 8,192 pages are 2^63.
    pages = [(i, "http://good.org/", link("friend.net") if i == 0 else None) for i in range(8192)]
    pages += [(i, "https://x.example.org/es/", "") for i in range(8192, 16400)]
    pages += [(20000, "http://other.org/", ""), (20001, "http://friend.net/", ""), (20002, "http://farm.net/", link("x.example.org")), (20003, "http://y.example.org/es/", "")]
    found = sorted(map(tuple, url_trust.judge(frame(spark, pages), URL_RULES).collect()), key=str)
    assert found == brute(pages)
    by_host = {r[1]: r for r in found}
    assert by_host["friend.net"][4] == "allow" and by_host["friend.net"][5] > 0
    assert by_host["farm.net"][4] == "block" and by_host["farm.net"][6] > 0


def test_trust_and_distrust_travel_more_than_ten_links(spark):
    ways = [f"h{i}.net" for i in range(14)]
    pages = [(0, "http://good.org/", link(ways[0])), (99, "http://x.example.org/es/", "")]
    pages += [(i + 1, f"http://{a}/", link(b)) for i, (a, b) in enumerate(zip(ways, [*ways[1:], "x.example.org"], strict=True))]
    found = {r.host: r for r in url_trust.judge(frame(spark, pages), URL_RULES).collect()}
    own = url_trust.UNIT * (1 - url_trust.DAMPING)
    for i, host in enumerate(ways):
        # A chain has a closed form: what the seed keeps, damped by every link; each link rounds down by less than a unit.
        for score, links in ((found[host].host_trust, i + 1), (found[host].host_distrust, len(ways) - i)):
            assert abs(score - own * url_trust.DAMPING**links) <= links + 2
        assert found[host].verdict == ("block" if len(ways) - i <= i + 1 else "allow")


class Targets(HTMLParser):
    """Hosts of the absolute targets, read attribute by attribute."""

    def __init__(self, html):
        super().__init__()
        self.hosts = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        found = [urlsplit((value or "").strip()) for name, value in attrs if name in ("href", "src")]
        self.hosts += [u.netloc.lower() for u in found if u.scheme and u.netloc]


def test_links_in_every_notation(spark):
    html = (
        "<a href='http://single.net/it?a=1'>x</a><a href=http://bare.net/y>x</a><a href=http://end.net>x</a><A HREF=\"HTTP://Upper.net\">x</A>"
        "<a class=c href = \"https://blank.net/a'b\">x</a><img alt='' Src\n=\n' http://inner.net/ '><a href=\"http://double.net:80?q\">x</a>"
        "<a href=\"/go?to=http://query.net/\">x</a><a href='mailto:a@b.net'>x</a><a href=local.html>x</a><a href=\"\">x</a>"
    )
    expected = sorted(Targets(html).hosts)
    assert len(expected) == 7 and "query.net" not in expected
    row = spark.createDataFrame([(html,)], "html string")
    links = row.select(url_trust.F.explode(url_trust.F.regexp_extract_all("html", url_trust.F.lit(url_trust.LINK), url_trust.F.lit(1))).alias("link"))
    assert sorted(r[0] for r in links.select(url_trust.host_of(url_trust.F.col("link"))).collect()) == expected
    pages = [(1, "http://good.org/", html), *((i, f"http://{h}/", "") for i, h in enumerate(expected, 2))]
    found = {r.host: r.host_trust for r in url_trust.judge(frame(spark, pages), URL_RULES).collect()}
    assert all(found[h] > 0 for h in expected)
