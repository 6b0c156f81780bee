import html
import re

from quern.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x</p>";</script></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>ly<br>two&nbsp;&#233;<p>Three<!-- no --> x &lt; y</p><div class="ad box">Buy</div>
<form><p>Mail</p><input name="x"></form><ul><li>i1<li>i2</ul><section id="comments"><p>First!</p></section></article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE, []) == "Head & line\nOne boldly two é\nThree x < y\ni1\ni2"
    assert H.main_text(None, []) == H.main_text("", []) == ""
    assert H.main_text("plain < text &amp;", []) == "plain < text &"
    assert H.main_text("<p>a<p>b</b></i>c", []) == "a\nbc"
    assert H.main_text("<script>never ends <p>x", []) == ""
    assert H.main_text("<div " * 3000, []) is not None
    assert len(H.main_text("<p>" + "word " * 200_000, [])) == 999_999


def test_end_tags_that_are_left_out():
    many = lambda tag: "".join(f"<{tag}>{i}" for i in range(300))
    for menu in (f"<form><select>{many('option')}</select></form>", f"<nav><table><tr>{many('td')}</table></nav>", f"<aside><dl>{many('dd')}</dl></aside>", f"<nav>{many('div')}</nav>"):
        assert H.main_text(f"<body>{menu}<article><p>Text</article>", []) == "Text"
    assert H.main_text("<table><tr><td><p>a<td class=ad>no<td>b<tr><th>c</table>d", []) == "a\nb\nc\nd"


def test_wrapper_finds_slots_optional_and_repeated_groups():
    page = lambda title, items, extra="": f"<body><div><h1>{title}</h1><span>Read</span>{extra}<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul></div></body>"
    wrapper = H.infer([page("a", "xyz"), page("b", "uvwx", "<b>new</b>"), page("c", "q")])
    flat = str(wrapper)
    assert "['+', [['<li'], ['#', None], ['</li']]]" in flat
    assert "['?', [['<b'], ['#', 'new'], ['</b']]]" in flat
    assert "['<h1'], ['#', None]" in flat and "['#', 'Read']" in flat
    # Without an article element, what is the same on all of a host's pages is no main text.
    assert H.main_text(page("d", "mn"), wrapper) == "d\nm\nn"


def expected(page):
    """The given tables' pages, by plain patterns."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_op3_on_the_tables(spark):
    from quern.llm.queries import op3_html_extraction

    sf = "/root/testdata/sf0.01"
    want = {r.page_id: expected(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op3_html_extraction(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, "http://a/x", PAGE, 1), (2, None, None, 2), (3, "http://a/x", "", 3), (3, "http://a/x", "", 3), (None, "", "<p>x", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int")
    out = H.extract(df).collect()
    assert sorted((r.page_id or 0, r.text.count("\n"), r.n_chars > 0) for r in out) == [(0, 0, True), (1, 4, True), (2, 0, False), (3, 0, False), (3, 0, False)]
    assert H.extract(df.limit(0)).count() == 0


def test_template_is_counted_over_all_pages(spark):
    same, word = "The same start of a paragraph. " * 10, "abcdefghijklmnop"
    page = lambda i, body: f"<html><body id=x{word[i % 16]}><article><div class=note><p>Sign up now</p></div><h1>Title {i}</h1>{body}</article></body></html>"
    rows = [(i, "http://a/", page(i, f"<p>{same}{i}</p><p>Own {i}.</p>")) for i in range(20)]
    # Copies of one text in different html, alone on a host and among others; without an article element.
    bare = lambda i, text: f"<body><div class=k{word[i % 16]}>{'<hr>' * i}</div><div><p>{text}</p><p>Second.</p></div></body>"
    rows += [(100 + i, "http://b/", bare(i, "Copy.")) for i in range(8)]
    rows += [(200 + i, "http://c/", bare(i, "Copy." if i < 30 else f"{same}{i}").replace("<p>Second.", f"<p>{'Second.' if i < 30 else i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(out[i] == f"Title {i}\n{same}{i}\nOwn {i}." for i in range(20))
    assert all(out[100 + i] == "Copy.\nSecond." for i in range(8))
    assert all(out[200 + i] == ("Copy.\nSecond." if i < 30 else f"{same}{i}\n{i}") for i in range(40))


def site(spark, n=12):
    """A host whose layout says nothing by its names: the main part, teasers that vary on each page, and a menu."""
    said = lambda i, k: f"{'lorem ipsum dolor ' * 5}{i} {k}"
    page = lambda i: f"""<html><body><div class=t{i}><p>Offer {i}!</p><p>Only {i} left</p></div><div class=x1><a href=/>Home</a><a href=/{i}>Link {i}</a></div>
<div class=k><h1>Title {i}</h1><div><p>{said(i, 1)}</p><blockquote>{said(i, 2)}</blockquote><p>All rights {i}</p><address>Reserved.</address></div></div><div class=z>Seen {i} times</div></body></html>"""  # noqa: E731
    rows = [(i, "https://site/a", page(i)) for i in range(n)] + [(n, "https://site/b", "<body><p>Another layout</p></body>")]
    want = {i: f"Title {i}\n{said(i, 1)}\n{said(i, 2)}\nAll rights {i}" for i in range(n)} | {n: "Another layout"}
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


def test_the_wrapper_decides(spark):
    df, want = site(spark)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want
    found = H.templates(df.select(H.host_key(df.url).alias("host"), "html")).collect()
    assert [list(r.part) for r in found] == [["<html", "<body", "<div class=k"]]
    # Without the wrapper, what varies elsewhere comes in.
    without = {r.page_id: H.main_text(r.html, []) for r in df.collect()}
    assert all("Offer" in without[i] and "Seen" in without[i] for i in range(12))


def test_the_tables_without_names(spark, monkeypatch):
    """The wrappers alone, without article elements and class words, give the tables' main text; run here, where both can be emptied."""
    monkeypatch.setattr(H, "MAIN", set())
    monkeypatch.setattr(H, "DROPPED_WORDS", set())
    hosts = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("html", r"regexp_extract(url, '://([^/?#]*)', 1) as host").collect():
        hosts.setdefault(r.host, []).append(r.html)
    many = [pages for pages in hosts.values() if len(pages) >= 6]
    for pages in many:
        wrapper = H.infer(pages[:6])
        tags, fixed, sums = H.wrapper_tags(wrapper), H.fixed_texts(wrapper), {}
        for page in pages:
            for path, text, head in H.slots(page, tags):
                if H.whole(text) not in fixed:
                    n, heads = sums.get(path, (0, 0))
                    sums[path] = n + len(text), heads + head
        part = H.main_part([(list(p), *n) for p, n in sums.items()])
        assert [H.main_text(page, [], part=part) for page in pages] == [expected(page) for page in pages]
        assert all(H.main_text(page, []) != expected(page) for page in pages)
    assert sum(map(len, many)) > 50


def test_part_of_a_page():
    texts = [(["<html", "<body", "<div class=a"], 900, 0), (["<html", "<body", "<article", "<p"], 1000, 0), (["<html", "<body", "<article", "<h1"], 20, 5)]
    assert H.main_part(texts) == ["<html", "<body", "<article"]
    assert H.main_part([]) == [] and H.main_part([([], 9, 0)]) == []
    page = "<body><section class='a b'><p>in</p></section><section><p>out</p></section>"
    assert H.main_text(page, [], part=["<body", "<section class=a b"]) == "in" and H.main_text(page, [], part=["<body", "<section"]) == "in\nout"
    assert H.main_text(page, [], part=["<body", "<main"]) == "in\nout"  # no text there: judged by names
    deep = "<div>" * 5000 + "x"
    assert H.main_text(deep, []) == "x" and len(H.infer([deep, deep])) > 0


def test_folds_and_gaps_of_any_length():
    row = lambda n: "<table>" + "".join(f"<tr>{''.join(f'<td>{i}</td>' for i in range(90))}</tr>" for _ in range(n)) + "</table>"
    flat = str(H.infer([row(3), row(5), row(4)]))
    assert flat.count("'<tr'") == 1
    note = "<section>" + "".join(f"<p{i}>x</p{i}>" for i in range(100)) + "</section>"
    flat = H.infer([f"<body><h1>a</h1>{note}<h2>b</h2></body>", "<body><h1>a</h1><h2>b</h2></body>", "<body><h1>a</h1><h2>b</h2></body>"])
    assert [n[0] for n in flat] == ["<body", "<h1", "#", "</h1", "?", "<h2", "#", "</h2", "</body"]


def test_a_main_part_that_is_the_body_leaves_it_to_names(spark):
    spread = lambda i: f"<html><body><article><p>Own {i}</p></article>{''.join(f'<{t}><p>Other text {i}</p></{t}>' for t in ('section', 'div', 'table', 'ul', 'dl'))}</body></html>"
    df = spark.createDataFrame([(i, "http://s/", spread(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(df).collect()} == {i: f"Own {i}" for i in range(8)}


def test_all_pages_of_a_host_make_its_wrapper(spark):
    """A page in twenty says something else where the others say the same: whichever pages come first, that is fixed."""
    said = lambda i, k: f"{'lorem ipsum dolor ' * 5}{i} {k}"
    note = lambda i: f"Printed by {i}" if i % 20 == 0 else "Printed by us"
    page = lambda host, i: f"<html><body id={host}><div class=k><h1>Title {i}</h1><div><p>{said(i, 1)}</p><blockquote>{said(i, 2)}</blockquote></div><address>{note(i)}</address></div></body></html>"
    df = spark.createDataFrame([(1000 * h + i, f"https://h{h}/", page(f"h{h}", i)) for h in range(12) for i in range(80)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {1000 * h + i: f"Title {i}\n{said(i, 1)}\n{said(i, 2)}" + (f"\nPrinted by {i}" if i % 20 == 0 else "") for h in range(12) for i in range(80)}
