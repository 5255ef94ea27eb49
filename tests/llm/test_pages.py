"""Wrappers and language identification on small pages."""

import html
import random
import re
import time

import pytest

from ledgerloom.llm import language, wrappers

PAGE = "page_id long, url string, html string"


def article(k, body, extra=""):
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>T {k}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>'
        f'<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home {k}</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div>'
        f'<!-- <p>gone</p> --><div class="ad">Buy {k}</div>{body}<aside>Related {k}</aside><section id="comments"><p>Nice {k}</p></section>{extra}'
        f"<form><label>Mail</label><input><button>Go</button></form><footer>&copy; site</footer></body></html>"
    )


def test_article_only(spark):
    rows, want = [], {}
    for k in range(12):
        paragraphs = "".join(f"<p>Part {k} {j} &amp; <b>so</b>&nbsp;on\n x<br>y" for j in range(k % 4 + 1))
        inner = f"<h1>Title {k}</h1>{paragraphs}" + ("<ul><li>one<li>two</ul>" if k % 3 == 0 else "") + "loose &lt;p&gt; end"
        rows.append((k, f"https://Www.Example.org:80/{k}", article(k, f"<article>{inner}</article>")))
        lines = [f"Title {k}"] + [f"Part {k} {j} & so on x y" for j in range(k % 4 + 1)]
        if k % 3:  # without a list the loose text is still in the last paragraph
            lines[-1] += "loose <p> end"
        else:
            lines += ["one", "two", "loose <p> end"]
        want[k] = "\n".join(lines)
    found = wrappers.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)


def test_pages_without_article(spark):
    text = "Long story of many words that goes on and on. "
    rows = [(k, f"http://b.example/{k}", article(k, f'<div class="wrap"><div class="content"><h2>Head {k}</h2><p>{text * 3}{k}</p><p>{text}</p></div></div>')) for k in range(6)]
    found = wrappers.extract(spark.createDataFrame(rows, PAGE)).collect()
    for r in found:
        assert r.text == f"Head {r.page_id}\n{text * 3}{r.page_id}\n{text.strip()}"


def test_odd_pages(spark):
    rows = [
        (1, "http://c.example/", None), (2, None, "<p>plain"), (3, "no address", ""), (4, "http://c.example/", "<article><p>cut <b"),
        (5, "http://d.example/", "<article>" + "<p>word</p>" * 30000 + "</article>"), (5, "http://d.example/", "<article><p>again</article>"),
        (None, "http://e.example/", "a < b and <1> &#65;&amp;amp;"), (7, "http://f.example/", "<script>while(1)"),
    ]
    df = spark.createDataFrame(rows, PAGE).withColumn("host", wrappers.F.lit(1)).withColumn("wrapper", wrappers.F.lit(2))
    found = sorted(wrappers.extract(df).collect(), key=lambda r: (str(r.page_id), r.n_chars))
    assert [(r.page_id, r.text[:20]) for r in found] == [
        (1, ""), (2, "plain"), (3, ""), (4, "cut"), (5, "again"), (5, "word\nword\nword\nword\n"), (7, ""), (None, "a < b and <1> A&amp;"),
    ]
    assert found[5].n_chars == 5 * 30000 - 1
    assert wrappers.extract(df.limit(0)).collect() == []


def test_alignment_makes_optional_and_repeated_groups():
    shape = lambda page: wrappers.fold(wrappers._copy(wrappers.tree(page)))
    first = shape("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>")
    assert [(n[0], n[1]) for n in first[0][2]] == [("h2", wrappers.REPEATED), ("p", wrappers.REPEATED)]
    both = wrappers.align(first, shape("<div><h2>a</h2><table><tr><td>x</table><p>b</p></div>"))
    assert [(n[0], n[1] & 3) for n in both[0][2]] == [("h2", 2), ("table", 1), ("p", 2)]
    assert both[0][2][0][2] == [["#", 0, 3]]  # a slot, with the characters of all pages


def rows_of(lang, words, n, rng):
    return [(" ".join(rng.choice(words) for _ in range(12)), lang) for _ in range(n)]


EN, DE = "the of and to in that was for it with house dog".split(), "der die und das ist nicht mit ein haus hund von zu".split()


def test_fusion(spark):
    rng = random.Random(8)
    known = spark.createDataFrame(rows_of("en", EN, 60, rng) + rows_of("de", DE, 60, rng) + [(None, "en"), ("x", None)], "text string, lang string")
    rows = []
    for k in range(60):  # a host with German pages only, its declarations all wrong
        rows.append((k, "en", "org", "de.example.org", "example.org", rows_of("de", DE, 1, rng)[0][0]))
    for k in range(100, 160):
        rows.append((k, "en", "com", "en.example.com", "example.com", rows_of("en", EN, 1, rng)[0][0]))
    rows += [(200, None, None, "de.example.org", "example.org", "Haus"), (201, None, None, "en.example.com", "example.com", "xyzzy")]
    rows += [(202, "en", "org", "de.example.org", "example.org", None), (203, "en", None, None, None, ""), (None, None, None, None, None, "der hund ist")]
    df = spark.createDataFrame(rows, "id long, declared string, suffix string, host string, parent string, text string")
    found = {r.id: r for r in language.identify(df, known).collect()}
    assert len(found) == len(rows)
    assert all(found[k].lang == "de" for k in range(60)) and all(found[k].lang == "en" for k in range(100, 160))
    assert found[200].lang == "de" and found[201].lang == "en"  # by the host, where the text says little
    assert (found[202].lang, found[202].probability, found[203].lang) == ("und", 0.0, "und")
    assert found[None].lang == "de"
    assert language.identify(df.limit(0), known).collect() == []
    assert {r.lang for r in language.identify(df, known.limit(0)).collect()} == {"und"}


def test_rejects_texts_without_words(spark):
    rng = random.Random(1)
    known = spark.createDataFrame(rows_of("en", EN, 40, rng) + rows_of("de", DE, 40, rng), "text string, lang string")
    rows = [(1, "the house", "en", "a", 1), (2, "", "en", "a", 1), (3, None, None, None, None), (4, "der hund", None, None, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone int")
    left = language.keep_identified(docs, known)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 4}


def test_addresses_are_no_words():
    text = "With +1 (807) 555-5623 xqzvkw.06@mail4.example.com THE https://qqq.example/zzz a1b and."
    assert language.letters(language.pa.array([text, None, "12 ##"])).to_pylist() == ["with the and ", "", " "]


FOREIGN = {
    500: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era",
    501: "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил",
    502: "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心",
    503: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
}


def test_foreign_and_junk_documents_are_rejected(spark):
    """Planted between the documents, whose declared language and source they carry; clean ones of few words stay."""
    rng = random.Random(4)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in given.collect()]
    letters, signs = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(33, 127)))
    gone = dict(FOREIGN)
    gone[510] = " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(40))
    gone[511] = " ".join("".join(rng.choices(signs, k=rng.randrange(2, 12))) for _ in range(80))
    gone[512] = "4785 380592 12.5 2024-01-02 ### $$$"
    start = max(d[0] for d in docs) + 1
    planted = [(start + k, text, "en", docs[0][3]) for k, text in gone.items()]
    short = [(start + 1000 + k, " ".join(t.split()[:4]), lang, s) for k, (_, t, lang, s) in enumerate(docs)]
    both = [(start + 5000, docs[0][1] + " " + next(d[1] for d in docs if d[2] != docs[0][2]), docs[0][2], docs[0][3])]
    rows = spark.createDataFrame(docs + planted + short + both, "doc_id long, text string, lang string, source string")
    left = {r.doc_id for r in language.keep_identified(rows, given.select("text", "lang")).collect()}
    assert not left & {d[0] for d in planted}
    assert left == {d[0] for d in docs + short + both}
    found = {r.id: r for r in language.identify(language.document_rows(rows), given.select("text", "lang")).collect()}
    assert all((found[d[0]].lang, found[d[0]].text_lang, found[d[0]].probability) == ("und", "und", 0.0) for d in planted)


@pytest.mark.parametrize("url, host, suffix", [("http://User@A.b.Example.COM:8080/x", "a.b.example.com", "com"), ("nothing", "", ""), (None, "", "")])
def test_page_rows(spark, url, host, suffix):
    row = language.page_rows(spark.createDataFrame([(1, url, "<HTML class=x LANG='De-at'><script>a</script>b &amp; c")], PAGE)).first()
    assert (row.host, row.suffix, row.declared, row.text.split()) == (host, suffix, "de", ["b", "c"])


TEXT = "This is the paragraph of text that should be there."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article class='post comments-open'><p>{TEXT}</p></article><footer>f</footer>", TEXT),
        (f"<article class='post category-promo'><p>{TEXT}</p></article>", TEXT),
        (f"<main class='has-menu'><p>{TEXT}</p></main>", TEXT),
        (f"<div class='layout with-sidebar'><article><p>{TEXT}</p></article><div class='sidebar'>side</div></div>", TEXT),
        (f"<article><p>{TEXT}</p><h2 id='related-work'>Related work</h2><p>more</p></article>", f"{TEXT}\nRelated work\nmore"),
        (f"<article><p>{TEXT}</p><section id='copyright'><p>c</p></section></article>", f"{TEXT}\nc"),
        (f"<article><p title=\"x>oops</p><p>{TEXT}</p></article>", f"oops\n{TEXT}"),
        # Readers' comments go however long, related articles and named boxes too.
        (f"<article><p>{TEXT}</p></article><section id='comments'><article><p>{TEXT * 9}</p></article></section>", TEXT),
        (f"<article><p>{TEXT}</p></article><div class='related-posts'><article><p>a</p></article></div>", TEXT),
        (f"<div class='sidebar-left'>x</div><div class='content'><p>{TEXT}</p></div><div class='main-nav'>y</div>", TEXT),
    ],
)
def test_names_of_elements(spark, page, want):
    df = spark.createDataFrame([(1, "http://a.example/1", f"<html><body>{page}</body></html>")], "page_id long, url string, html string")
    (row,) = wrappers.extract(df).collect()
    assert (row.text, row.n_chars) == (want, len(want))


def test_deep_pages(spark):
    deep = "<body><article>" + "<div>" * 100_000 + TEXT
    hidden = "<body><nav>" + "<div>" * 1000 + "menu</nav><p>" + TEXT
    lists = "<body><article>" + "<ul><li>" * 3000 + TEXT
    df = spark.createDataFrame([(k, f"http://{k}.example/", h) for k, h in enumerate((deep, hidden, lists))], "page_id long, url string, html string")
    assert [r.text for r in wrappers.extract(df).orderBy("page_id").collect()] == [TEXT] * 3


def test_many_unlike_siblings():
    def page(mark, n=20_000):
        return "".join(f"<div class='{mark}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{mark}'><p>t</p></div>" for k in range(n))

    start = time.time()
    both = wrappers.align(wrappers.fold(wrappers._copy(wrappers.tree(page("q")))), wrappers.fold(wrappers._copy(wrappers.tree(page("x")))))
    assert len(both) > 30_000 and all(n[1] & wrappers.OPTIONAL for n in both)
    assert time.time() - start < 60


@pytest.mark.parametrize("seed", range(4))
def test_common_sequences(seed):
    """Both exact ways give a sequence as long as the table's; the greedy one gives a common sequence."""
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(300, 420))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    for long in (a, a + ["z"] * 40_000):
        found = wrappers._common(long, b)
        assert len(found) == best[0][0]
        assert all(long[i] == b[j] for i, j in found) and found == sorted(set(found))
    greedy = wrappers._common(a * 40, b * 40)
    assert len(greedy) > len(b) and all(a[i % len(a)] == b[j % len(b)] for i, j in greedy)


def by_markup(page):
    """The text between the article's tags, a line for each block, by plain replacement."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav)\b.*?</\1>", "", body, flags=re.S)
    lines = re.split(r"</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote|pre|table|tr|td|figure|figcaption)\b[^>]*>", body)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in lines]
    return "\n".join(x for x in lines if x)


def test_against_the_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    found = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert found.keys() == raw.keys()
    with_article = [k for k, h in raw.items() if h and "<article>" in h and "</article>" in h]
    assert len(with_article) > 0.8 * len(raw)
    for k in with_article:
        assert found[k] == by_markup(raw[k])
