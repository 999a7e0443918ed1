"""Page operators on made pages and urls."""

import time

from meterlake.llm import html_text, url_filter
from meterlake.llm.queries import URL_RULES

ARTICLE = "A long enough paragraph, with commas, and more than a few words, so that it scores well against the menus."


def test_main_text_keeps_the_article_alone():
    page = f"""<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p {{}}</style></head><body>
      <header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="sidebar"><p>{ARTICLE} side</p></div>
      <div id="content"><h1>Head &amp; line</h1><p>{ARTICLE}&nbsp;&quot;one&quot;<p>{ARTICLE} <b>two</b><br>
      tail</p><ul><li>first</li><li>second</ul><div class="ad-box">Buy, now, please, thanks, a lot of text here</div><form><p>Name</p></form></div>
      <section id="comments"><p>{ARTICLE} said a reader</p></section><div class="cookie-notice">We use, cookies</div><footer>&copy; us</footer>"""
    assert html_text.main_text(page).split("\n") == ["Head & line", f'{ARTICLE} "one"', f"{ARTICLE} two tail", "first", "second"]


def test_names_of_elements_tell_articles_from_the_rest():
    page = f"""<body><div class="site-header">Site, of, many, commas, {ARTICLE}</div><article class="post has-sidebar"><div class="entry-header"><h1>Title</h1></div>
      <p>{ARTICLE}</p><div class="with-sidebar"><p>more</p></div></article><article class="comment"><p>{ARTICLE} replied</p></article><aside>x</aside></body>"""
    assert html_text.main_text(page).split("\n") == ["Title", ARTICLE, "more"]


def test_main_text_of_odd_pages():
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<div></div>")
    assert html_text.main_text("plain text &lt;b&gt; &am x") == "plain text <b> &am x"
    assert html_text.main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert html_text.main_text("<article><p>short</p></article><footer>no") == "short"
    deep = "<div>" * 5000 + f"<p>{ARTICLE}</p>" + "</div>" * 5000
    assert html_text.main_text(deep) == ARTICLE
    assert html_text.main_text(f"<article><p>{ARTICLE}<p>next</article><!-- <p>hidden</p> -->") == f"{ARTICLE}\nnext"


def test_elements_without_end_tags_lose_no_article():
    for tag in ("svg", "math", "select", "object", "noframes", "noscript", "iframe", "template"):
        assert html_text.main_text(f"<article><p>a<{tag} x=1>no<p>b</article>") == "a\nb"
        assert html_text.main_text(f"<p>x<b><{tag}>no</b> y</p><{tag}>no<article><p>{ARTICLE}</article><{tag}>no</{tag}>") == ARTICLE
        assert html_text.main_text(f"<article><p>a<{tag}>no</p>b<p>c<{tag}>no</{tag}>d</article><{tag}>no</{tag}>") == "a\nb\ncd"
    for tag in ("svg", "object", "template"):
        assert html_text.main_text(f"<article><p>a<{tag}><div><{tag}><p>no</{tag}>no</div></{tag} >b</p></article>") == "ab"
    assert html_text.main_text("<article><p>a<svg><text>no</svg><script>var x = '<svg>'</script><select/>b") == "ab"
    assert html_text.main_text("<article><p>a<script>var x = '<p>b</article>'") == "a"


def test_doubtful_names_keep_prose_and_lose_links():
    links = "".join(f"<li><a href=/{i}>Another story about {i}</a></li>" for i in range(6))
    for name in ("discussion", "related-work", "search-results", "popular", "menu-planning", "social-history"):
        assert html_text.main_text(f"<article><p>{ARTICLE}</p><section class='{name}'><h2>Part</h2><p>{ARTICLE} here</p></section></article>").split("\n")[1:] == ["Part", f"{ARTICLE} here"], name
        assert html_text.main_text(f"<article><p>{ARTICLE}</p><div class='{name}'><h3>More</h3><ul>{links}</ul></div></article>") == ARTICLE, name
    assert html_text.main_text(f"<article><p>{ARTICLE}</p><div class='post-comments'><p>{ARTICLE}</p></div><div class=sidebar>{ARTICLE}</div></article>") == ARTICLE
    assert html_text.main_text("<body><article><p>One, short.</p></article><article><p>Two, short.</p></article></body>") == "One, short.\nTwo, short."
    assert html_text.main_text("<article><p>press <button>OK</button> or <label>x</label>wait</p></article>") == "press or wait"


def test_wrappers_of_any_name_keep_the_article():
    text = f"<h1>Title</h1><p>{ARTICLE} One.</p><p>{ARTICLE} Two.</p>"
    wanted = ["Title", f"{ARTICLE} One.", f"{ARTICLE} Two."]
    menu, foot = "<nav><a href=/>Home</a><a href=/b>News</a></nav>", "<footer>about us</footer>"
    for begin, end in (
        ("<form action=/post>", "<input name=q><select><option>no</select></form>"),
        ("<form><article>", "</article><label>no</label><button>no</button></form>"),
        *((f"<div class='{name}'>", "</div>") for name in ("ad-hoc-analysis", "social-history-essay", "share-class-letter", "sidebar-left-layout", "public-notice", "no-js menu")),
        *((f"<main><section id={name}>", "</section></main>") for name in ("public-notice", "banner")),
    ):
        assert html_text.main_text(f"<body>{begin}{menu}{text}{foot}{end}</body>").split("\n") == wanted, begin
    for name in ("comments", "cookie-notice", "newsletter", "sidebar", "site-banner", "ad-slot"):
        for page in (f"<article>{text}<div class={name}><p>{ARTICLE} no</p></div></article>", f"<div id=c>{text}</div><div class={name}><p>{ARTICLE} no</p></div>"):
            assert html_text.main_text(page).split("\n") == wanted, name
    assert html_text.main_text(f"<article>{text}<form><p>{ARTICLE} no</p><input></form></article>").split("\n") == wanted
    short = "<article><p>Short.</p><p>Also, short.</p></article>"
    assert html_text.main_text(f"{short}<div class='cookie notice'><a href=/>{ARTICLE}</a></div>") == "Short.\nAlso, short."


def test_lists_of_links_are_no_article():
    links = "".join(f"<li><a href=/{i}>Another story about {i}</a></li>" for i in range(12))
    text = f"<h1>Title</h1><p>{ARTICLE}</p><ul><li>one <a href=/>two</a> three</li><li>four</li><li>five</li><li>six</li></ul>"
    wanted = ["Title", ARTICLE, "one two three", "four", "five", "six"]
    for tag in ("main", "article", "div"):
        assert html_text.main_text(f"<{tag}><ul>{links}</ul>{text}</{tag}>").split("\n") == wanted, tag
        assert html_text.main_text(f"<{tag}>{text}<div><h3>More</h3><ul>{links}</ul></div></{tag}>").split("\n") == wanted, tag
    assert len(html_text.main_text(f"<main><ul>{links}</ul></main>").split("\n")) == 12


def test_hostile_pages_are_read_in_linear_time():
    n = 200_000
    for piece in ("<b>", "<b>\n<hr>x", "<a '", '<a "', "<a", "<", "<!", "<p", "<li>x</li>", "<iframe ", "<svg>", "<p>x<b>", "</p>", "<ul><li>", "<a \"x\"", "<!--", "<p class=", "&amp"):
        for page in (piece * (n // len(piece)), "<b>" * (n // 6) + piece * (n // 2 // len(piece)), "<div>" * (n // 10) + piece * (n // 2 // len(piece)) + "'>\">"):
            began = time.process_time()
            html_text.main_text(page)
            assert time.process_time() - began < 2, (piece, page[:10])


def test_hidden_is_an_attribute_and_not_a_word():
    for kept in ('title="a hidden gem"', "alt='hidden'", 'data-x = "y" title="no display: none" class="hidden-gem"', "aria-hidden=false", "href=hidden", 'title=" hidden = 1 "'):
        assert html_text.main_text(f"<article><p>a</p><p {kept}>b</p></article>") == "a\nb", kept
    for gone in ("hidden", "HIDDEN", 'title="x" hidden', 'hidden=""', "style='color: red; Display : none'", "id=x hidden=until-found", 'class="a"hidden'):
        assert html_text.main_text(f"<article><p>a</p><p {gone}>b</p></article>") == "a", gone


def test_extract_text_keeps_every_row(spark):
    pages = [(1, "u", "<p>é x</p>"), (1, "u", "<p>é x</p>"), (None, None, None), (3, "v", "")]
    got = html_text.extract_text(spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "é x", 3), (1, "u", "é x", 3), (None, None, "", 0), (3, "v", "", 0)], key=repr)
    assert not html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count()


def test_urls_by_rule_and_by_words(spark):
    urls = {
        "HTTP://WWW.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://casino.com/": ("casino.com", "/", "com/", "allow"),
        "http://casino.com": ("casino.com", "", None, "block"),
        "http://x.net/es/1#a": ("x.net", "/es/1", "net/es/", "block"),
        "http://free-bets.org/": ("free-bets.org", "/", None, "block"),
        "http://free.org/free": ("free.org", "/free", None, "allow"),
        "http://essex.org/a": ("essex.org", "/a", None, "allow"),
        "no scheme xxx": ("", "", None, "block"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u, "host") for i, u in enumerate(urls)] + [(None, None, "host")] * 2
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), URL_RULES).collect()
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert {u: by_id[i] for i, u in enumerate(urls)} == urls
    assert sum(r.page_id is None and r.verdict == "allow" for r in got) == 2


def test_urls_take_a_vocabulary_table_and_hostile_rows(spark):
    words = spark.createDataFrame([("Zebra", 2), ("zebra", 1), ("lion", 1), ("tiger", 1), ("", 2), (None, 2), ("zero", 0)], "word string, weight int")
    urls = ["http://a.org/zebra", "http://a.org/lion", "http://a.org/lion/tiger", "http://a.org/porn", "http://a.org/zero", "http://a.org/" + "x" * 200_000 + "/zebra", "://", "a://b://c"]
    table = spark.createDataFrame([(i, u, "clash", 7) for i, u in enumerate(urls)], "page_id long, url string, rule string, weight int")
    got = {r.page_id: r for r in url_filter.filter_urls(table, [], vocabulary=words).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert (got[6].host, got[6].path, got[7].host, got[7].path) == ("", "", "b:", "//c")
    assert not url_filter.filter_urls(table.limit(0), URL_RULES).count()
