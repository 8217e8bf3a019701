from pyspark.sql import functions as F

from panelweave.llm import html_text

LONG = "The committee said that it will be in the north of the island and that there was no more to say about it."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>not text";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">{LONG}</div>
<main><article><header><h1>Head &amp; line</h1></header><p>{LONG} <b>Bo</b>ld&nbsp;&lt;x&gt;<br>next<p>Es.</p><div class="ad">{LONG}</div>
<p>{LONG}<!-- c --></p><form><p>{LONG}</p></form><section id="comments"><p>{LONG}</p></section></article></main>
<aside><p>{LONG}</p></aside><footer>{LONG}</footer></body></html>"""
TEXT = f"Head & line {LONG} Bold <x> next Es. {LONG}"


def text(html):
    return html_text.main_text(html)[0]


def test_article_alone_is_kept():
    assert text(PAGE) == TEXT


def test_unmarked_page_is_decided_by_density():
    junk = "Login Register Deals Basket Checkout Prices Brands Outlet Offers Coupons Vouchers"
    page = f"<div><a href=x>One</a> <a href=y>Two</a></div><div>{junk}</div><h2>Short head</h2><div>{LONG}</div><p>Yes.</p><div>{LONG}</div><p>{junk}</p><p>Top</p>"
    assert text(page) == f"Short head {LONG} Yes. {LONG}"


def test_short_article_without_neighbours_is_kept():
    assert text("<article><p>Es.</p></article>") == "Es."
    assert text("<body><p>Hello</p></body>") == "Hello"


def test_broken_markup():
    assert text("<article><p>a < b and <b>c<p>d</article>") == "a < b and c d"
    assert text(f"<article><p>{LONG}<script>never closed {LONG}") == LONG
    assert text(f"<article></p></div>{LONG}</nav></article>") == LONG
    assert text("<article><a title='>' href=\"x>y\">l</a> text <img alt='>'> end of a sentence that is long enough</article>") == "l text end of a sentence that is long enough"
    assert text('<p ' + '"' * 50_001 + "<" * 2000) == ""  # linear on hostile input
    assert text("<i>" * 20_000 + LONG + "</b>" * 20_000) == LONG


def test_edges(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (5, "u", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "n_kept": F.lit(1)})
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    whole = " ".join([LONG] * 5000)
    assert got == [(1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0), (3, "", 0), (4, "", 0), (5, whole, len(whole))]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_unmarked_page_in_an_unlisted_language():
    first = "Комитет сообщил, что заседание пройдёт на севере острова и что добавить больше нечего."
    second = "Η επιτροπή ανακοίνωσε ότι η συνεδρίαση θα γίνει στο βόρειο τμήμα του νησιού την Κυριακή."
    links = "<div><a href=x>Главная страница сайта</a> <a href=y>Последние новости</a></div>"
    assert text(f"{links}<h2>Заголовок</h2><p>{first}</p><p>Да.</p><p>{second}</p>{links}") == f"Заголовок {first} Да. {second}"


def test_names_between_paragraphs_are_kept():
    names = "Abara Lindqvist, Chidi Okonkwo, Marta Kowalska, Jan Novak, Ines Duarte"
    assert text(f"<div>{LONG}</div><div>{names}</div><div>{LONG}</div>") == f"{LONG} {names} {LONG}"
    assert text(f"<div>{names}</div>") == names


def test_links_inside_an_article():
    linked = f"<p><a href=q>{LONG}</a></p>"
    assert text(f"<article><h1><a href=p>A headline that is a permalink</a></h1><p>{LONG}</p>{linked}<p>Es.</p><p>{LONG}</p></article>") == (
        f"A headline that is a permalink {LONG} {LONG} Es. {LONG}")
    menu = "<ul>" + "".join(f"<li><a href={i}>Entry {i}</a></li>" for i in range(5)) + "</ul>"
    assert text(f"<article><p>{LONG}</p>{menu}</article>") == LONG
    sources = "<ul><li>Ann Lee: <a href=1>A report on the island</a></li><li>Bo Roe: <a href=2>A second report on it</a></li></ul>"
    assert text(f"<article><p>{LONG}</p>{sources}</article>") == f"{LONG} Ann Lee: A report on the island Bo Roe: A second report on it"


def test_layout_classes_keep_the_article():
    whole = text(PAGE)
    for name in ("layout has-sidebar", "no-comments", "post-share-wrap", "ad-hoc-notes", "related-work", "with-sidebar", "sidebar", "sidebar-open"):
        assert text(PAGE.replace("<body>", f'<body><div class="{name}">').replace("</body>", "</div></body>")) == whole
    assert text(PAGE.replace("<main>", "<form><main>").replace("</main>", "</main></form>")) == whole
    aside = f'<div class="related-posts"><article><p>{LONG}</p></article></div>'
    assert text(PAGE.replace("</main>", "</main>" + aside)) == whole  # an article in a zone, beside one outside


def test_names_of_zones():
    for name in ("sidebar", "sidebar-left", "left_sidebar", "siteFooter", "comment-list", "post-comments", "cookie-banner", "nav-menu", "share-buttons",
                 "related-posts", "ad", "ad-slot", "ads728x90", "sidebar__inner", "footer-links", "newsletter-signup", "widget-area"):
        assert html_text.names_zone(name), name
    for name in ("has-sidebar", "no-comments", "post-share-wrap", "ad-hoc-notes", "related-work", "content", "main-content", "header-image", "entry",
                 "research", "adrift", "with-sidebar", "article-body", "left", "123", "--"):
        assert not html_text.names_zone(name), name


def test_end_tags_left_out():
    assert text(f'<article><p class="promo">Buy<p>{LONG}<p>Es.</article>') == f"{LONG} Es."
    assert text(f'<article><ul><li class="share">{LONG}<li>{LONG}</ul></article>') == LONG
    assert text(f'<article><dl><dt class="ad">x<dd>{LONG}<dt class="ad">y</dl></article>') == LONG
    assert text(f'<article><table><tr class="ad"><td>x<tr><td class="ad">y<td>{LONG}</table></article>') == LONG
    assert text(f'<article><p class="ad">Buy<div>{LONG}</div></article>') == LONG
    assert text(f'<article><div class="ad"><ul><li>x<li>y</ul></div><ul><li>{LONG}<ul class="menu"><li>z</ul></ul></article>') == LONG


def test_quotes_left_open():
    assert text(f'<article><p class="x>{LONG}</p></article>') == LONG
    assert text(f'<article><p>{LONG} <a href="x>l</a> and <b class="y">on</b> it goes, for a while.</p></article>') == f"{LONG} l and on it goes, for a while."
    assert text('<p ' * 30_000).count("<p") == 30_000  # no tag, and linear


def brute_page(rng):
    """A page with a known article, in one of several layouts, with zones around and inside it."""
    article = []
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.choice(["p", "p", "p open", "h2", "li", "ad", "form"])
        if kind in ("p", "p open"):
            out.append(f"<p>{LONG}" + ("</p>" if kind == "p" else ""))
            article.append(LONG)
        elif kind == "h2":
            out.append("<h2>Head of it</h2>")
            out.append(f"<p>{LONG}</p>")
            article += ["Head of it", LONG]
        elif kind == "li":
            out.append(f"<ul><li>{LONG}<li>{LONG}</ul>")
            article += [LONG, LONG]
        else:
            out.append(f'<div class="{rng.choice(["ad", "share-buttons", "post-comments"])}">{LONG}</div>' if kind == "ad" else f"<form>{LONG}</form>")
    body = "".join(out)
    mark = rng.choice(["article", "main", "div role=main"])
    body = f"<{mark}>{body}</{mark.split()[0]}>"
    for zone in ("nav", "aside", "footer", 'div class="sidebar"', 'div id="comments"'):
        part = f"<{zone}><p>{LONG}</p></{zone.split()[0]}>"
        body = rng.choice([body, part + body, body + part])
    return rng.choice(["<body>{}</body>", '<body><div class="has-sidebar">{}</div></body>', '<form id="page">{}</form>']).format(body), " ".join(article)


def test_pages_with_a_known_article():
    import random
    rng = random.Random(4)
    for _ in range(400):
        html, article = brute_page(rng)
        assert text(html) == article, html
