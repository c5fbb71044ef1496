import re

from haplospark.llm import wrappers


def page(i, body, ad="Buy now"):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">{ad} {i}</div>
<div id="c0"><h1>Title {i}</h1>{body}<div class="share-box">Share this</div><div>Read it twice</div></div>
<div class="x1"><ul><li><a href="#">One {i}</a></li><li><a href="#">Two {i}</a></li></ul></div>
<div class="comments"><p>I disagree {i}</p></div><footer>&copy; me {i}</footer></body></html>"""


def test_blocks():
    got = wrappers.blocks("<p>a  <b>b</b>c<br>d &amp; e&nbsp;f<p>g</p><script>if (a<b) '</p>'</script><li>h<li>i &am")
    assert [t for _, t, *_ in got] == ["a bc", "d & e f", "g", "h", "i &am"]
    assert wrappers.blocks("") == [] and [t for _, t, *_ in wrappers.blocks("x <p")] == ["x"]


def test_alignment_makes_optional_and_repeated_groups():
    a, b = (wrappers.tree(wrappers.blocks(h)) for h in ("<div><h1>t</h1><p>a</p><p>b</p></div>", "<div><h1>t</h1><h2>s</h2><p>a</p></div>"))
    (div,) = wrappers.align(a, b)
    assert [(n[0], n[1], n[2]) for n in div[3]] == [("h1", False, False), ("h2", True, False), ("p", False, True)]
    two = wrappers.tree(wrappers.blocks("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"))
    assert [(n[0], n[2]) for n in two[0][3]] == [("dt", True), ("dd", True)]


def test_extract(spark):
    bodies = ["<p>" + " ".join(f"word{i}{k}" for k in range(20)) + "</p>" * (i % 2) + f"<p>Second <i>par</i>t {i} &lt;here&gt;</p>" for i in range(8)]
    rows = [(i, f"http://h.com/{i}", page(i, b), "x") for i, b in enumerate(bodies)]
    article = "<html><body><header>Site</header><article><header><h1>Head</h1></header><p>Only one.</p></article><aside>no</aside></body></html>"
    rows += [(100, "http://one.org/", article, None), (101, None, None, None), (102, "http://h.com/z", "", None), (103, "http://h.com/q", article, None), (103, "http://h.com/q", article, None), (None, "::bad[", "<p>alone</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [r.asDict() for r in wrappers.extract(df).collect()]
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    for i, b in enumerate(bodies):
        plain = re.sub(r"<[^>]+>", " ", b.replace("<i>", "").replace("</i>", "")).replace("&lt;", "<").replace("&gt;", ">")
        assert by_id[i] == " ".join(f"Title {i} {plain}".split())
    assert by_id[100] == by_id[103] == "Head Only one." and by_id[101] == by_id[102] == "" and by_id[None] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.extract(df.limit(0)).count() == 0


def test_article_keeps_links_and_repeated_text():
    body = lambda i: f"""<html class="no-ads"><body class="has-sidebar"><nav><p>Menu</p></nav><article class="post widget"><h1><a href="/{i}">Title {i}</a></h1><p class="lead"><a href="#">Lead {i}</a></p>
<p>{" ".join(f"word{i}_{k}" for k in range(30))}</p><ul><li><a href="#">Source {i}</a></li></ul><h2>Methods</h2><p>See <a href="#">A &amp;  B &amp;   C</a></p></article></body></html>"""  # noqa: E731
    pages = [wrappers.blocks(body(i)) for i in range(4)]
    w = wrappers.Wrapper()
    for found in pages:
        w.add(found)
    for i, found in enumerate(pages):
        text = wrappers.main_text(found, w.rule())
        assert text == f"Title {i} Lead {i} " + " ".join(f"word{i}_{k}" for k in range(30)) + f" Source {i} Methods See A & B & C"
    (block,) = wrappers.blocks("<div>See <a>A &amp; B &amp; C</a></div>")
    assert block[2] < len(block[1])


def texts(pages):
    w = wrappers.Wrapper()
    found = [wrappers.blocks(p) for p in pages]
    for f in found:
        w.add(f)
    return [wrappers.main_text(f, w.rule()) for f in found]


def prose(i, n=30):
    return " ".join(f"word{i}_{k}" for k in range(n))


def test_slot_of_the_expression_decides():
    """A constant paragraph before the heading and varying ones behind it have one path, but two slots."""
    page = lambda i: f"<body><div><p>We use cookies to serve you.</p><h1>Title {i}</h1><p>{prose(i)}</p><p>{prose(i + 50)}</p></div></body>"
    assert texts([page(i) for i in range(4)]) == [f"Title {i} {prose(i)} {prose(i + 50)}" for i in range(4)]
    flat = [t for t in wrappers.blocks(page(0))]
    own = wrappers.Wrapper(wrappers.tree(flat))  # one page tells nothing of what varies
    assert wrappers.main_text(flat, own.rule()).startswith("We use cookies")


def test_long_notice_on_all_pages():
    notice = "This notice stands on all pages of the host and is long. " * 7
    page = lambda i: f"<body><div><h1>T{i}</h1><p>{prose(i, 80)}</p><div>{notice}</div></div></body>"
    assert texts([page(i) for i in range(10)]) == [f"T{i} {prose(i, 80)}" for i in range(10)]


def test_elements_that_never_close():
    assert texts(['<article><p>one two three</p><svg viewBox="0 0 1 1"/><p>four five six</p></article>']) == ["one two three four five six"]
    assert texts(["<article><p>one two three</p><button>x<p>four five six</p></article>"]) == ["one two three x four five six"]
    assert texts(["<article><p>one</p><button>x</button><svg><text>y</text></svg><p>two</p></article>"]) == ["one two"]


def test_names_inside_an_article():
    page = lambda i: f"""<body><article><h1>T{i}</h1><p>{prose(i)}</p><div class="legal">Court of {prose(i, 5)}</div><div class="share">Share this</div><div class="ad">{prose(-i, 4)}</div>
<section id="comments"><p>I, too, {i}</p></section></article></body>"""  # noqa: E731
    assert texts([page(i) for i in range(4)]) == [f"T{i} {prose(i)} Court of {prose(i, 5)}" for i in range(4)]


def test_optional_and_repeated_parts():
    extra = lambda i: f"<h2>Part {i}</h2><p>{prose(i + 9)}</p>" * (i % 3) + (f"<table><tr><td>{prose(i + 30, 6)}</td></tr></table>" if i % 2 else "")
    page = lambda i: f"<body><div id='top'><a href='/'>Home</a></div><div id='mid'><h1>T{i}</h1><p>{prose(i)}</p>{extra(i)}</div><div id='end'>All rights</div></body>"
    plain = lambda h: " ".join(re.sub(r"<[^>]+>", " ", h).split())
    assert texts([page(i) for i in range(8)]) == [plain(f"T{i} {prose(i)} {extra(i)}") for i in range(8)]


def test_irregular_pages_become_one_group():
    rng = __import__("random").Random(1)
    body = lambda i: "".join(f"<{t}>{prose(f'{i}_{k}', 6)}</{t}>" for k, t in enumerate(rng.choice(["p", "h2", "pre", "blockquote", "h3"]) for _ in range(rng.randint(40, 90))))
    bodies = [body(i) for i in range(30)]
    got = texts([f"<body><nav>Menu</nav><div>{b}</div><footer>End</footer></body>" for b in bodies])
    assert got == [" ".join(re.sub(r"<[^>]+>", " ", b).split()) for b in bodies]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>" + prose(1) + "</p>" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>{prose(k, 8)}</p><h2>{k}</h2>" for k in range(3000)) + "</article>"
    df = spark.createDataFrame([(1, "http://d.org/", deep), (2, "http://l.org/", long), (3, "http://b.org/", "<p <div><<a href=' </p> &#xZZ; &bogus; <article")], "page_id long, url string, html string")
    got = {r.page_id: r for r in wrappers.extract(df).collect()}
    assert got[1].text == prose(1) and got[2].text.count("word") == 24000 and got[3].n_chars == len(got[3].text)


def plain_matching(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_matching_is_longest_at_every_length():
    import random

    rng = random.Random(2)
    for n in (0, 1, 5, 40, 200):
        for _ in range(30):
            letters = "abcdefghij"[: rng.choice([1, 2, 4, 10])]
            a, b = ([rng.choice(letters) for _ in range(rng.randrange(n + 1))] for _ in range(2))
            pairs = wrappers.matching(a, b)
            assert len(pairs) == plain_matching(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))


def test_long_levels_align_exactly():
    for n in (900, 1_040, 6_000):
        common = [f"t{i}" for i in range(n)]
        a, b = ["x", *common], [*common, "y"]
        assert wrappers.matching(a, b) == [(i + 1, i) for i in range(n)]
        assert wrappers.matching(a + a, b) == [(i + 1, i) for i in range(n)] and len(wrappers.matching(["p"] * n, ["q"] * n)) == 0


def test_order_is_kept_beyond_forty_tokens():
    level = lambda names: [[x, False, False, [], None, []] for x in names]
    names = [f"t{i}" for i in range(60)]
    out = wrappers.align(level(names), level(names[:30] + ["new"] + names[30:]))
    assert [x[0] for x in out] == names[:30] + ["new"] + names[30:] and [x[1] for x in out] == [x == "new" for x in (*names[:30], "new", *names[30:])]
