from quantloom.llm import extraction as E

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="nav-open">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href='/b>c'>B</a></ul></nav><div class="ad">Buy now</div><!-- <p>x</p> -->
<div class="cookie-notice"><p>We use cookies, many of them.</p></div>
<div id="w7"><div class="post-%d"><h1>Head &amp; line</h1><p>First   para<b>graph</b>,<br>with &eacute;t&#233; &lt;b&gt;.<p>Second one, with <a href="#">a link</a> in it.
<ul><li>item one</li><li>item two</ul><form><input value="q"><button>Go</button></form></div>
<div class="sidebar"><p>Other news of today, and more.</p></div><section id="comments"><p>Reader says, this is a long comment on the article.</p></section></div>
<footer>&copy; all</footer></body></html>"""
TEXT = "Head & line\n\nFirst paragraph, with été <b>.\n\nSecond one, with a link in it.\n\nitem one\n\nitem two"


def test_one_page():
    assert E.extract(PAGE % 3) == TEXT
    assert E.extract(None) == E.extract("") == E.extract("<p") == ""
    assert E.extract("just  text &amp here") == "just text & here"


def test_consensus_decides_for_poor_pages(spark):
    poor = "<body><div class='x1'><p>Hi.</p></div><div class='y'><p>This text is longer than the article and tries to win, so it would.</p></div></body>"
    rich = "<body><div class='x%d'><p>" + "A good sentence, and again. " * 20 + "</p></div><div class='y'><p><a>This text is longer than the article and tries to win, so it would.</a></p></div></body>"
    rows = [(i, f"http://h.example/{i}", rich % i) for i in range(9)] + [(9, "http://H.example?x", poor), (10, None, None), (None, "http://other/", PAGE % 1)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in E.extract_pages(pages).collect()}
    assert len(got) == 12 and got[9] == "Hi." and got[10] == "" and got[None] == TEXT
    assert all(got[i].startswith("A good") and "longer" not in got[i] for i in range(9))
    assert E.extract_pages(pages.limit(0)).count() == 0


def test_names_of_layouts_are_no_boilerplate():
    text = "A good sentence, and again. " * 5
    for name in ("class='layout has-sidebar'", "class='no-sidebar'", "class='with-comments'", "id='page-search'", "class='sidebar'"):
        for tag in ("article", "div"):
            page = f"<body><div {name}><{tag}><p>{text}</{tag}><div class='sidebar'><p>Other news.</div><div class='related-posts'><article><p>A card.</article></div></div></body>"
            assert E.extract(page) == text.strip(), (name, tag)
    assert E.extract(f"<body><p>Short.<div id='comments'><article class='comment-body'><p>{text}</article></div></body>") == "Short."


def test_whole_article_beside_boilerplate():
    a, b, noise = "The first part says it. " * 16, "The second part says it. " * 24, "A reader says so. " * 55
    split = f"<section class='a'><p>{a}</section><section class='b'><p>{b}</section><div class='comments'><p>{noise}</div>"
    want = "\n\n".join(["Heading of it all", a.strip(), b.strip()])
    menu = f"<nav>{noise}</nav>"
    for page in (f"<body>{menu}<article><h1>Heading of it all</h1>{split}</article><p>Ends here.</body>", f"<body>{menu}<div class='post'><h1>Heading of it all</h1>{split}</div></body>"):
        assert E.extract(page) == want
        path = next(p for x in E.blocks_of(page) for _, p in x.inside if p.endswith("section.b"))
        assert E.extract(page, [path]) == want  # the host's path is one part only
    twins = f"<body>{menu}<article><p>{a}</article><article><p>{b}</article></body>"
    assert E.extract(twins) == f"{a.strip()}\n\n{b.strip()}"


GOOD = "A good sentence, and again. " * 20


def test_page_wide_form_and_odd_quotes():
    assert E.extract(f"<body><form action='x'><div class='a'><article><p>{GOOD}</article></div></form></body>") == GOOD.strip()
    assert E.extract(f"<body><div class='a'><p>{GOOD}</div><form><p>Name: <input><p>Send it to us.</form></body>") == GOOD.strip()
    for tag in ("<p title=it's>", '<p title=5">', "<p it's>", '<p "x>', "<p a = 'b>c'>", '<p a="b>c">'):
        assert E.extract(f"<body><div class='a'>{tag}{GOOD}<p>The second isn't lost.</div></body>") == f"{GOOD.strip()}\n\nThe second isn't lost."


def test_deep_nesting_takes_bounded_memory():
    import tracemalloc

    for page in ("<div class='x sidebar#'>x" * 100_000, "<div>" * 50_000 + "</p></b>" * 50_000, "<a " * 50_000, "<p a='" * 50_000, "<b>" * 50_000 + "<p>x" * 1000):
        tracemalloc.start()
        E.extract(page.replace("#", ""), ["/div/div.a"])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6, peak


def test_pages_of_known_parts(spark):
    """Random sites: the text is the article's blocks, whatever stands round them."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n)) + "."
    noise = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a>' for _ in range(9))}</ul></nav>", lambda: f"<div class='side-bar sidebar'><p>{say(20)}</div>",
        lambda: f"<footer>&copy; {say(8)}</footer>", lambda: f"<div id=comments><div class=comment><p>{say(30)}</div></div>", lambda: f"<script>if (a<b) {{ {say(5)} }}</script><style>p {{}}</style>",
        lambda: f"<div class='ad-banner'><a href=x>{say(6)}</a></div>", lambda: f"<form class=search><input><button>{word()}</button></form>", lambda: f"<div class=cookie-notice>{say(9)}</div>", lambda: f"<!-- {say(4)} -->",
    ]
    rows, want = [], {}
    for site in range(8):
        shell = rng.choice(["<div class='layout has-sidebar'><div class='post n%d'>{}</div></div>", "<main><article>{}</article></main>", "<table><tr><td class=c%d>{}</td></tr></table>", "<div id=p%d><section>{}</section></div>"])
        for page in range(12):
            parts = [say(rng.randrange(15, 60)) for _ in range(rng.randrange(4, 9))]
            body = "".join(f"<p class=x{page}>{p}</p>" if rng.random() < 0.8 else f"<h2>{p}</h2>" for p in parts)
            around = [f() for f in rng.choices(noise, k=5)]
            html = "<html><head><title>T</title></head><body>" + "".join(around[:3]) + (shell % page if "%d" in shell else shell).format(body) + "".join(around[3:]) + "</body></html>"
            rows.append((len(rows), f"http://s{site}.org/{page}", html))
            want[len(rows) - 1] = "\n\n".join(parts)
    rows += [rows[3], rows[3]]
    got = E.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_named_parts_inside_the_article():
    """Comments, adverts, notices and hidden parts go by names that no list has as a whole; names of layouts stay."""
    noise = "A reader says so, and says it again. " * 8
    names = ["class='user-comments'", "class='article-comments'", "class='fb-comments'", "id='disqus_thread'", "class='google-ad'", "class='ad-slot'", "class='privacy-notice'", "class='gdpr'", "class='related-stories'", "style='display:none'", "style='color:red; DISPLAY : none'"]
    for shell in ("<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"):
        for name in names:
            page = "<body>" + shell.format(f"<h1>Title</h1><p>{GOOD}</p><div {name}><p>{noise}</p></div><p>The end.</p>") + "</body>"
            assert E.extract(page) == f"Title\n\n{GOOD.strip()}\n\nThe end.", (shell, name)
        page = "<body>" + shell.format(f"<p>{GOOD}</p><ol class='commentlist'><li>{noise}</ol>") + "</body>"
        assert E.extract(page) == GOOD.strip()
        for name in ("class='has-ads'", "class='ad-free'", "class='without-comments'", "class='comments-open'", "class='no-cookie'"):
            assert E.extract("<body>" + shell.format(f"<div {name}><p>{GOOD}</p></div>") + "</body>") == GOOD.strip(), (shell, name)


def test_title_in_the_articles_own_header():
    page = f"<body><header><h1>Site name</h1></header><article><header><h1>Title</h1><p>By somebody, today.</p></header><p>{GOOD}</p><footer>Filed under.</footer></article></body>"
    assert E.extract(page) == f"Title\n\n{GOOD.strip()}"


def test_null_urls_repeat_and_names_clash(spark):
    page = f"<body><article><p>{GOOD}</p></article></body>"
    rows = [(1, None, page, "x", 1), (1, None, page, "y", 2), (2, None, None, "z", 3), (3, "no url", page, "w", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in E.extract_pages(pages).collect())
    assert got == [(1, "", GOOD.strip(), len(GOOD.strip())), (1, "", GOOD.strip(), len(GOOD.strip())), (2, "", "", 0), (3, "no url", GOOD.strip(), len(GOOD.strip()))]
