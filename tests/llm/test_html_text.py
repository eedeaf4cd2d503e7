import random

from emberloom.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>No &lt;b&gt;</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy<div>more</div></div><article><h1>T&amp;C &#233;</h1><p><b>One  <i>two</i>
three<br>four<p class="ad">Advert<p>Five &lt; six &am</p><aside>Side</aside><ul><li>a<li>b</ul>
<form><p>name</p></form><section id="comments"><p>Nice!</p></section><p title="a > b">Last&nbsp;line 1 < 2</article>
<footer>&copy; x</footer></body></html>"""


def test_structure():
    assert ht.main_text(ht.lines(PAGE), None) == "T&C é\nOne two three four\nFive < six &am\na\nb\nLast line 1 < 2"


def test_odd_markup_does_not_crash():
    rng = random.Random(1)
    parts = ["<", ">", "<p", "</p>", "<article>", "</article>", "<div class='ad'>", "\"", "'", "<!--", "-->", "&amp;", "x y", "<script>", "</script>", "<br/>", "é", "\n"]
    for _ in range(500):
        ht.lines("".join(rng.choices(parts, k=rng.randint(0, 40))))
    assert ht.lines(None) == ht.lines("") == []


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = rng.choices("abcde", k=rng.randint(0, 12)), rng.choices("abcde", k=rng.randint(0, 12))
        at = ht.common_lines(a, b)
        rest = iter(b)
        assert at == sorted(set(at)) and all(any(a[k] == y for y in rest) for k in at) and len(at) == lcs_length(a, b)


def test_differencing_of_pages_without_an_article(spark):
    shell = "<body><div>Welcome to Site</div><div>{}</div><p>{}</p><div>Contact us</div></body>"
    rows = [(k, f"http://h.example/a/{k}", shell.format(f"Head {k}", f"Body {k}"), "c") for k in range(40)]
    rows += [(100, "http://other.example/", shell.format("Only", "one"), "c"), (101, None, None, "c"), (102, "::", "", None), (101, None, None, "c"), (None, "http://h.example/a/39", PAGE, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    got = ht.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert all(by_id[k] in (f"Head {k}\nBody {k}",) for k in range(1, 38))
    assert by_id[100] == "Welcome to Site\nOnly\none\nContact us" and by_id[101] == by_id[102] == ""
    assert by_id[None].startswith("T&C")


def test_copied_pages_keep_their_text(spark):
    rows = [(k, f"http://h/{k}", "<div>same</div><div>text</div>") for k in range(3)] + [(k, f"http://h/{k}", "<article><p>Same</p></article><footer>f</footer>") for k in (7, 8)]
    got = ht.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == ["Same"] * 2 + ["same\ntext"] * 3
    assert ht.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_end_tags_may_be_left_out():
    article = "<article><p>A</article>"
    for before in (
        "<head><title>t</title><body>", "<head><meta charset=x><title>t</title>", "<html><head><link rel=x><script>1</script><body>",
        "<ul><li class='share'>s<li>x</ul>", "<ul><li>x<li class='share'>s</ul>", "<ol><li class=ad>a<ul><li>b</ul><li>c</ol>",
        "<dl><dt class=ad>a<dd>b<dt>c</dl>", "<dl><dd class=ad>a</dl>", "<table><tr><td class=ad>a<td>b<tr><th class=ad>c</table>",
        "<table><thead class=menu><tr><td>a<tbody><tr class=ad><td>b</table>", "<div><li class=share>s</div>",
        "<select><option>a<option>b</select>", "<datalist><option>a</datalist>", "<table><caption class=ad>k<tr><td>x</table>",
    ):
        assert ht.main_text(ht.lines(before + article), None) == "A", before
    items = [t for t, mark in ht.lines("<ul><li class=share>s<li>x<li class=ad>a<ul><li>b</ul><li>y</ul><p>z") if mark == ht.FREE]
    assert items == ["x", "y", "z"]
    cells = [t for t, mark in ht.lines("<table><tr><td class=ad>a<tr><td>b<td class=ad>c<table><tr><td>d</table>e<tr><td>f</table>g") if mark == ht.FREE]
    assert cells == ["b", "f", "g"]
    assert [t for t, mark in ht.lines("<head><title>t</title>Text") if mark == ht.FREE] == ["Text"]


def test_names_judge_no_part_of_an_article_by_chance():
    page = (
        '<article><h2 id="search-methods">Search</h2><section id="related-work"><p>Related</p></section><p id="social-history">Social</p>'
        '<p class="notice-board">Board</p><div class="ad-slot">Buy</div><ol class="comment-list"><li>Nice</ol><div class="social-history">Kept</div></article>'
    )
    assert ht.main_text(ht.lines(page), None) == "Search\nRelated\nSocial\nBoard\nKept"


def brute_settle(pages):
    """Each page's text from all pages in order, by plain dynamic programming on the definition."""

    def common(a, b):
        t = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = (*t[i][j], i) if x == y else max(t[i][j + 1], t[i + 1][j], key=len)
        return t[-1][-1]

    rows = sorted((ht._key(u, i), h) for i, u, h in pages)
    parsed = [[x for x in ht.lines(h) if x[1] != ht.NOISE] for _, h in rows]
    out = {}
    for k, ((host, path, i), _) in enumerate(rows):
        own = [t for t, _ in parsed[k]]
        near = [n for n in (k - 1, k + 1) if 0 <= n < len(rows) and rows[n][0][0] == host]
        near.sort(key=lambda n: -ht._same_start(rows[n][0][1], path))
        shared = [set(own[x] for x in common(own, [t for t, _ in parsed[n]])) for n in near if [t for t, _ in parsed[n]] != own]
        main = [t for t, m in parsed[k] if m in (ht.MAIN, ht.SUSPECT_MAIN)]
        if main:
            kept = [t for t, m in parsed[k] if m == ht.MAIN or m == ht.SUSPECT_MAIN and not any(t in s for s in shared)]
        else:
            sure = [t for t, m in parsed[k] if m == ht.FREE or not any(t in s for s in shared)]
            kept = [t for t in sure if not shared or t not in shared[0]] or sure
        out[i] = "\n".join(kept)
    return out


def site():
    """Pages whose lines are all different within a page, with shells by host, articles and suspect boxes."""
    rng = random.Random(9)
    rows = []
    for i in range(260):
        host = rng.choice(["a.example", "b.example", "c.example"])
        body = "".join(f"<p>Page {i % 200} line {k} {rng.randint(0, 3)}</p>" for k in range(rng.randint(1, 5)))
        box = rng.choice(["", f'<div class="related-posts">See {rng.randint(0, 2)}</div>'])
        body = f"<article>{body}{box}<div>Follow {host}</div></article>" if rng.random() < 0.4 else f"<div>{body}</div>{box}"
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{rng.randint(0, 99)}", f"<div>Welcome to {host}</div>{body}<div>Contact {host} {rng.randint(0, 1)}</div>"))
    return rows


def test_answers_do_not_depend_on_partitions_and_equal_brute_force(spark, monkeypatch):
    rows = site()
    want = brute_settle(rows)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 8, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r["page_id"]: r["text"] for r in ht.extract(pages.repartition(3)).collect()}
            assert got == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_and_hostile_pages_take_little_time():
    import time

    began = time.perf_counter()
    lines = [f"<div>{'x' if k % 3 else 'y'}</div>" for k in range(60_000)]
    a, b = ht.lines("".join(lines)), ht.lines("".join(lines[1::2] + lines[::3]))
    assert len(ht.main_text(a, b)) > 0
    for page in ('<a b="' * 200_000, "<a '>" * 200_000, "<!" * 500_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<p class=ad>" * 80_000 + "t", "<" * 1_000_000):
        ht.lines(page)
    assert time.perf_counter() - began < 30
