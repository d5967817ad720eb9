import random
import time

from pyspark.sql import functions as F

from pulsegrain.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home<li>More</ul></nav><div class="ad-box">Buy now</div><!-- <p>hidden</p> -->
<article><h1>Head &eacute;</h1><p>One   two&nbsp;three <b>four</b><p>Five<br>six &lt;x&gt;<aside>side</aside><form><p>mail?</form><ul><li>a<li>b</ul>
<section id="comments"><p>first!</p></section></article><footer>foot</footer></body></html>"""


def all_recur(source):
    """The text of a page whose proposed places were all seen to recur."""
    lines = html_text.Lines(source)
    return lines.chosen(set(), {html_text._number(f"\0{p}") for p in lines.place if p is not None})


def test_article_of_a_marked_page():
    assert all_recur(PAGE) == ["Head é", "One two three four", "Five", "six <x>", "a", "b"]
    # what was never seen to recur stays, but for forms, comments and hidden parts
    assert html_text.Lines(PAGE).chosen(set()) == ["Site", "Home", "More", "Buy now", "Head é", "One two three four", "Five", "six <x>", "side", "a", "b", "foot"]


def test_markup_is_read_in_linear_time():
    began = time.time()
    for source in ("<a" * 50_000, "<" + "a" * 100_000, "<a " * 50_000 + ">", "<a b=\"" * 20_000, "<a b='\"" * 20_000, "<!--" * 30_000, "</p>" * 30_000 + "<div>" * 30_000 + "</p>" * 30_000, "<div class='x'>" * 20_000 + "deep", "<a b=" + " " * 100_000 + "\"", "<x ='>\"<" * 10_000, "<script>" * 20_000, "&" * 100_000):
        html_text.Lines(source)
    assert time.time() - began < 12


def test_odd_quotes_leave_no_markup():
    text = lambda source: html_text.Lines(source).chosen(set())
    assert text('<article><p class="x>Hello</p><p>more</p></article>') == ["Hello", "more"]
    assert text('<article><p class="x>Hello</p><p class="y">more</p></article>') == ["Hello", "more"]
    assert text("<p title=\"it's\">a<p data=it's>b<p title='x>y<z' class=c>d") == ["a", "b", "d"]
    assert text('<p data-html="<b>x</b>">a</p><p title = "a > b">c') == ["a", "c"]
    assert text("<a<b>x</b>") == ["x"] and text("x <a href='") == ["x <a href='"]


def test_broken_markup_and_parts_that_are_no_article():
    text = all_recur
    assert text("<div class='ad'>Buy<article><p>Kept<p>too") == ["Kept", "too"]
    assert text("<article><p>Story</p><div class='commentlist'><article><p>first!</p></article></div></article>") == ["Story"]
    assert text("<main><header><h1>Title</h1></header><p>a<div id='cookie-notice'>ok?</div><p>b</main><p>after") == ["Title", "a", "b"]
    assert text("plain &amp; simple") == ["plain & simple"] and text("<p>a < b</p>") == ["a < b"] and text("<p title='x>y'>z") == ["z"]
    assert text("<nav>menu</nav><p>one<aside>no</aside>") == ["one"] and text("<script>never ends <p>x") == []


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_places_are_a_longest_common_subsequence():
    for seed in range(1500):
        rng = random.Random(seed)
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = html_text.common_places(a, b)
        rest = iter(b)
        assert len(places) == lcs(a, b) and all(a[i] in rest for i in places)


def test_long_pairs_keep_few_rows():
    rng = random.Random(1)
    a, b = ([rng.randint(0, 40) for _ in range(900)] for _ in range(2))
    places = html_text.common_places(a, b)
    rest = iter(b)
    assert len(places) == lcs(a, b) and all(a[i] in rest for i in places)


def test_shared_lines_go_where_no_article_is_marked(spark):
    def page(k):
        return f"<body><p>Menu</p><p>Story {k} begins</p><p>It ends {k}</p><p>All rights</p></body>"

    rows = [(k, f"https://a.example/x/{k:03d}", page(k), 1) for k in range(40)] + [(100, "https://b.example/", page(7), 1), (101, None, None, 1), (None, "https://a.example/x/005b", "", 1), (3, "https://a.example/x/003", page(3), 1), (102, "https://c.example/1", PAGE, 1), (103, "https://c.example/2", PAGE.replace("Head", "Other").replace("Home", "Back"), 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, shared int")
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got if r.page_id != 3}
    for k in (0, 10, 39):
        assert by_id[k] == f"Story {k} begins\nIt ends {k}"
    assert by_id[100] == "Menu\nStory 7 begins\nIt ends 7\nAll rights"  # alone on its host
    assert by_id[101] == "" and by_id[None] == "" and by_id[102].startswith("Head é\n")
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_copies_are_no_partners(spark):
    def page(k, end="All rights"):
        return f"<body><p>Menu</p><p>Story {k} begins</p><p>It ends {k}</p><p>{end}</p></body>"

    # copies beside their page, under another query string, in many tasks, and alone on their host
    rows = [(k, f"https://a.example/x/{k:03d}", page(k)) for k in range(20)] + [(k, "https://a.example/x/004?again", page(4)) for k in range(100, 103)]
    rows += [(200 + k, f"https://a.example/x/007/{k:03d}", page(7)) for k in range(300)] + [(4, "https://a.example/x/004", page(4))] * 2
    rows += [(600 + k, "https://b.example/", page(1)) for k in range(3)] + [(700, "https://c.example/1", page(1)), (701, "https://c.example/2", page(1).replace("</body>", "<p>More</p></body>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if "//a.example" in r.url:
            k = int(r.url[20:23])
            assert r.text == f"Story {k} begins\nIt ends {k}", r
        else:
            assert r.text == ("More" if r.page_id == 701 else "Menu\nStory 1 begins\nIt ends 1\nAll rights"), r


def test_runs_meet_the_nearest_page_with_other_lines(spark):
    rng = random.Random(3)
    kinds = [f"<p>Menu</p><p>only {k}</p><p>{'odd' if k % 2 else 'even'}</p><p>tail {k % 3}</p>" for k in range(5)]
    rows = [(k, f"https://{rng.choice('ab')}.example/{''.join(rng.choice('xy') for _ in range(rng.randint(0, 5)))}", kinds[min(4, int(rng.expovariate(0.8)))]) for k in range(120)]
    rows += [(1000 + k, f"https://h.example/{k:04d}", kinds[2 if 3 <= k < 500 else k % 2]) for k in range(510)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = [(i, u[8], u.split(".example")[1], html_text.Lines(h).text) for i, u, h in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many tasks
    try:
        got = html_text.shared_lines(df.withColumn("sig", F.xxhash64("html"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {r.page_id: r.shared for r in got}
    assert len(got) == len(rows)
    for i, host, path, lines in pages:
        others = [(html_text._near(path, p), t) for _, h, p, t in pages if h == host and t != lines]
        best = max(n for n, _ in others)
        assert found[i] in [html_text.common_places(lines, t) for n, t in others if n == best]


def generated_pages(n=60):
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(400))
    some = lambda k: " ".join(word() for _ in range(k))
    rows = []
    for k in range(n):
        host = rng.choice(["a", "b", "c"])
        body = f"<article><h1>{some(3)}</h1>" + "".join(f"<p>{some(6)}" for _ in range(rng.randint(1, 4))) + "</article>" if k % 3 else f"<p>{some(5)}</p><div class='box'>{some(4)}</div><p>{some(5)}</p>"
        menu = "".join(f"<li>{some(1)}" for _ in range(rng.randint(3, 6)))
        once = f"<div class='notice'>{some(4)}</div>" if rng.random() < 0.5 else ""
        extra = f"<section id='x{rng.randrange(10**6)}' class='related'>{some(4)}</section>" if k % 5 == 0 else ""
        rows.append((k, f"https://{host}.example/{rng.choice('xyz')}/{rng.randrange(40)}", f"<body><nav>{menu}</nav><p>Same on all</p>{once}{body}<div class='ad-box'>{some(5)}</div>{extra}<footer>{host} {some(2)}</footer></body>"))
    return rows + [(7, rows[7][1], rows[7][2]), (200, rows[8][1] + "?q", rows[8][2]), (201, "https://d.example/", rows[9][2]), (202, None, None), (None, rows[10][1], "")]


def brute_texts(rows):
    """Texts by host and path order, a plain LCS and counts in dicts."""
    pages = []
    for i, url, source in rows:
        host, path = (url[8:].split("?")[0].split("/", 1) if url else ("", ""))
        pages.append((host, "/" + path if url else "", str(i) if i is not None else "", url or "", i, html_text.Lines(source or "")))
    pages.sort(key=lambda p: (p[0], p[1], p[4] is not None, p[4] or 0, p[3]))
    found, tally = [], {}
    for at, page in enumerate(pages):
        keys = page[5].keys()
        near = []
        for step in (-1, 1):
            j = at + step
            while 0 <= j < len(pages) and pages[j][0] == page[0] and pages[j][5].keys() == keys:
                j += step
            if 0 <= j < len(pages) and pages[j][0] == page[0]:
                near.append(pages[j])
        best = max(near, key=lambda p: html_text._near(page[1], p[1]), default=None)
        shared = set(html_text.common_places(keys, best[5].keys())) if best else set()
        places = {k for k, p in zip(keys, page[5].place, strict=True) if p is not None}
        found.append((page, shared, places))
        if best:
            for p in places:
                n = tally.setdefault((page[0], p), [0, 0])
                n[0] += 1
                n[1] += p in {keys[k] for k in shared}
        for p in () if best else places:
            tally.setdefault((page[0], p), [0, 0])
    recurring = set()
    for (host, p), (n, same) in tally.items():
        all_n, all_same = (sum(x[c] for (_, q), x in tally.items() if q == p) for c in (0, 1))
        if all_same and (same + html_text.OTHERS * all_same / all_n) / (n + html_text.OTHERS) >= html_text.RECURS:
            recurring.add((host, p))
    out = []
    for (host, *_, i, lines), shared, places in found:
        plain = {k for k in shared if not lines.main[k] and lines.place[k] is None}
        out.append((i, "\n".join(lines.chosen(plain, {p for p in places if (host, p) in recurring}))))
    return sorted(out, key=str), set(tally) - recurring, recurring


def test_whole_query_equals_a_plain_version(spark, monkeypatch):
    rows = generated_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for recurs in (html_text.RECURS, 0.9):  # with the larger bound fewer places recur
        monkeypatch.setattr(html_text, "RECURS", recurs)
        want, others, recurring = brute_texts(rows)
        assert others and recurring
        for most, held in ((html_text.BROADCAST_NUMBERS, html_text.RUN_ROWS), (0, 1)):
            monkeypatch.setattr(html_text, "BROADCAST_NUMBERS", most)
            monkeypatch.setattr(html_text, "RUN_ROWS", held)
            assert sorted(((r.page_id, r.text) for r in html_text.extract_text(df).collect()), key=str) == want


def test_long_runs_are_not_held(spark, monkeypatch):
    """Equal pages in a row, within tasks and over many of them, with a bound of 3 held pages."""
    monkeypatch.setattr(html_text, "RUN_ROWS", 3)
    page = lambda k: f"<p>Menu</p><p>only {k}</p><p>tail</p>"
    rows = [(k, f"https://a.example/{k:04d}", page(k // 37)) for k in range(800)] + [(None, None, None)] * 50
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == ("" if r.page_id is None else f"only {r.page_id // 37}")


def test_compound_names_and_inline_parts_are_no_marks():
    text = all_recur
    assert text("<article><p>I <a class='social'>like</a> it<div class='share-price'>9</div><div class='notice-board'>b</div><div class='share-buttons'>S</div><span hidden>no</span></article>") == ["I like it", "9", "b"]
    assert text("<article><p>a</p><section class='commentary'>said</section><section class='comments-list'>first!</section></article>") == ["a", "said"]


def test_differencing_decides_the_texts(spark):
    """Without what was seen in pairs each page has other text; with it the article is left."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    usual = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    differ = 0
    for r in pages.collect():
        lines = html_text.Lines(r.html or "")
        assert usual[r.page_id] == "\n".join(t for t, m in zip(lines.text, lines.main, strict=True) if m)
        differ += usual[r.page_id] != "\n".join(lines.chosen(set()))
    assert differ == len(usual)
