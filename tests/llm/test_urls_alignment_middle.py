"""URL rules, tokenizer alignment and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pulsegrain.llm import fill_in_middle, queries, token_alignment, url_rules
from pulsegrain.llm.queries import tokenizer_file

# --- URL rules


def plain_verdict(url, rules, default="allow"):
    """Host, path, rule and verdict by a look at every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    if not fits:
        return host, path, None, default
    _, _, verdict, rule = max(fits)
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "://", "http://", "http://?x", "https://NET/", "https://net", "http://net/a", "http://xnet/a", "http://a.net/", "http://a.net.", "http://.net/", "http://a..net/x", "http://example.net/en/", "http://example.net/en", "http://WWW.Example.NET/en/5?q=/de/#z",
    "http://example.net:80/en/", "http://user@m.example.net/en/x", "http://example.com/de/1", "http://m.example.com/de/", "http://m.example.com/DE/", "http://org/fr/", "http://x.y.org/fr/é", "http://x.org/#/fr/", "x://y://z/net/", "http://É.net/", "http://net/\n/x", "http://a-b.example.net/en/", "http://example/net/",
]


def test_rules_are_those_of_a_look_at_every_rule(spark):
    rows = [(k, u, "p", 3) for k, u in enumerate(URLS)] + [(None, "http://a.net/", "p", 3), (4, "http://a.net/", "p", 3), (4, "http://a.net/", "p", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string, key int")
    got = url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain_verdict(u, url_rules.RULES)) for i, u, _, _ in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_nested_rules_at_random(spark, seed):
    rng = random.Random(seed)
    labels, steps = ["a", "b", "a-", "ab", ""], ["/", "/a", "/a/", "/a/b", "/ab", ""]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(3), rng.choice(steps)) for _ in range(40))}.values())
    rows = [(k, f"http://{host(5)}{rng.choice(steps)}{rng.choice(steps)}") for k in range(400)] + [(1000 + k, "http://a.b/a/b") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(7)
    got = url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()
    want = {i: plain_verdict(u, rules) for i, u in rows}
    assert len(got) == len(rows)
    for r in got:
        host_, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.verdict) == (host_, path, verdict)
        assert rule == r.rule


def test_rules_of_equal_place_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    twice = url_rules.rule_table(spark, [("allow", "NET", "/"), ("block", "net", "/")])
    assert [tuple(r) for r in url_rules.judge(pages, twice).collect()] == [(1, "a.net", "/x", "net/", "block")]
    assert [tuple(r) for r in url_rules.judge(pages, twice.limit(0), default="block").collect()] == [(1, "a.net", "/x", None, "block")]
    assert url_rules.judge(pages.limit(0), twice).count() == 0


# --- tokenizer alignment

ALIGNED = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "\na", "a\n\nb", "a\r\nb;\r\nc", "x;\r", "{\r}", "a\tb", "a\x0bb\x0cc", "a\xa0 b", "a \xa0b", "a\x1c b", "a\x85 b", "a 　 b", "▁a", "a▁ b", "<s> </s> <|endoftext|> <unk>", "don't  he'll 'S 123 ４５", "日本語 テキスト", "ﬁ é ́a", "😀 😀😀", "\x00 \x00a",
    "<0x41> <0x0A>", "word " * 500, "x" * 3000, "  lead", "tail  \n", "a b\n", "a\n b", "a \n b", "if (x) {\r\n\treturn;\r\n}\r\n", "İ ǅ", "%%% $$ --- ...",
]


def plain_alignments(texts):
    """Result rows from whole texts, without segments."""
    words = token_alignment.vocabularies(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    links, groups, sizes = [], [], []
    for text in texts:
        links.append([])
        groups.append("")
        sizes.append((0, 0, 0))
        if not text:
            continue
        a, b = words.a.encode(" " + text, add_special_tokens=False).ids, words.b.encode(text)
        source = (" " + text).encode()
        if b"".join(words.bytes_a[i] for i in a) != source or b"".join(words.bytes_b[i] for i in b) != source:
            continue
        spans = []
        for ids, known in ((a, words.bytes_a), (b, words.bytes_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(known[i])))
                at += len(known[i])
            spans.append(found)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        parts, low = [], 0
        for end in ends:
            inside = [[i for i, (s, e) in zip(ids, found, strict=True) if low <= s and e <= end] for ids, found in zip((a, b), spans, strict=True)]
            parts.append("|".join(",".join(map(str, x)) for x in inside))
            low = end
        groups[-1] = ";".join(parts)
        sizes[-1] = (len(a), len(b), len(parts))
        start = 0
        for i, (s, e) in zip(a, spans[0], strict=True):
            while spans[1][start][1] <= s:
                start += 1
            k = start
            while k < len(b) and spans[1][k][0] < e:
                links[-1].append((i, b[k]))
                k += 1
    counts = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(*n, len(found), sum(counts[p] == most[p[0]] for p in found), sum(counts[p] for p in found), text) for n, found, text in zip(sizes, links, groups, strict=True)]


def aligned(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, block int, groups string")
    return token_alignment.align_tokenizers(docs.repartition(3), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), **more)


@pytest.mark.parametrize("blocks", [{}, {"block_segments": 5, "frequent": 7}, {"block_chars": 40, "frequent": 0}])
def test_alignment_is_that_of_whole_texts(spark, blocks):
    rows = [*enumerate(ALIGNED), (None, "null id"), (3, "again a b"), (3, "again a b")]
    got = sorted((tuple(r) for r in aligned(spark, rows, **blocks).collect()), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain_alignments([t for _, t in rows]), strict=True)), key=str)
    assert got == want


def test_alignment_of_random_and_of_real_texts(spark, sf):
    rng = random.Random(0)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "\t", ";", "{", "}", "'s", "12", "é", "\xa0", "\u2003", "\x1f", "日", "😀", "ing", ")", "\u0301"]
    rows = list(enumerate("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)))
    rows += [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    got = sorted((tuple(r) for r in aligned(spark, rows, block_segments=300, frequent=100, sample=500).collect()), key=str)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, plain_alignments([t for _, t in rows]), strict=True)), key=str)


def test_cuts_stand_where_no_token_reaches_across(spark):
    words = token_alignment.vocabularies(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    assert words.segments("ab  cd\n\nx;\r\ny") == [" ab", "  cd", "\n\nx;\r\ny"]  # the second vocabulary has a piece ";\r"
    assert words.segments("a\xa0 b c") == [" a\xa0 b", " c"]
    for text in filter(None, ALIGNED):
        assert "".join(words.segments(text)) == " " + text


def test_segments_are_tokenized_once(spark, tmp_path):
    """Rows of one segment from many blocks come back with its one alignment, a block's together."""
    rows = [(b, n, s) for b in range(20) for n, s in enumerate([" the", " a", "\n\nx"])]
    segments = spark.createDataFrame(rows, "block long, number long, segment string").repartition(4)
    got = token_alignment.aligned(segments, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).collect()
    found = {b: token_alignment.Aligned.unpacked([bytes(r.body) for r in got if r.block == b]) for b in range(20)}
    assert {tuple(x.groups()) for x in found.values()} == {tuple(found[0].groups())} and len(found[0].groups()) == 3
    assert found[0].groups()[:2] == ["262|272", "257|264"]
    assert aligned(spark, [(1, None)]).limit(0).count() == 0 and aligned(spark, []).count() == 0


# --- fill in the middle


def plain_example(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MIDDLES = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb\n", "a<P>b", "x<S>", "<M>", "<S\n>", "<\n<S\nP>\n", "é\n😀\n日本\n", "\r\n\x85\u2028\n x", "word " * 5000, "l\n" * 5000, "<" * 50 + "\n" + ">" * 50]


def test_examples_are_the_plain_ones(spark):
    rows = [(k, t) for k, t in enumerate(MIDDLES * 9)] + [(None, "null id\nx"), (3, "again\nb"), (3, "again\nb")]
    docs = spark.createDataFrame([(i, t, "f", 2) for i, t in rows], "doc_id long, text string, form string, n int")
    made = fill_in_middle.fill_in_middle(docs)
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(((i, *plain_example(i, t)) for i, t in rows), key=str)
    back = made.select("doc_id", "form", fill_in_middle.restored(made.output, made.form).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"\S*\s+|\S+"), ("character", r"(?s:.)")])
def test_offsets_are_those_of_a_list_of_units(unit, pattern):
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab \n\n é") for _ in range(rng.randint(0, 25)))
        units = re.findall(pattern, text)
        runs = fill_in_middle.ClassRuns(text, unit)
        assert runs.units == len(units)
        assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_shares_and_units_are_parameters(spark):
    docs = spark.createDataFrame([(k, f"a b c {k}\nd e") for k in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in fill_in_middle.fill_in_middle(docs, unit="word", percent=50, spm_percent=0).collect())
    assert forms["spm"] == 0 and 140 < forms["plain"] < 260
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.fill_in_middle(docs, unit="verse")


@pytest.mark.parametrize("name", ["op11_url_filters", "op13_fill_in_middle"])
def test_queries_give_the_rows_of_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).project(",".join(columns)).fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_alignment_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op12_token_alignment"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for d, (*numbers, groups) in zip(docs, plain_alignments([d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert numbers == [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum]
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
