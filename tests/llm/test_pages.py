"""HTML extraction and WARC archives."""

import hashlib
import io
import itertools

import pytest

from knotwork.llm import html_extract, warc
from knotwork.llm.common import new_path

from .helpers import prose, rows, table

COLUMNS = "page_id bigint, url string, html string"


def page(i, article, host="a.example.org"):
    return (
        i,
        f"https://{host}/p/{i}?x=1",
        f'<!DOCTYPE html><html><head><title>T {i}</title><script>var a="<article>no</article>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy {i}</div>'
        f'<article><header><h1>Head&eacute; {i}</h1></header>{article}</article><aside>side</aside><section id="comments-1"><p>I agree</p></section><form><input><label>mail</label></form><footer>&copy; {i}</footer></body></html>',
    )


def test_main_text(spark):
    long = "".join(f"<p>{prose(k, 200)}</p>" for k in range(100))
    pages = [page(1, "<p>One <b>b</b>old.<p>Two&nbsp;&lt;3\n\n x</p><div class='share'>share me</div>"), page(2, "<ul><li>a<li>b</ul>"), page(3, long), page(4, ""), (5, None, None), (6, "no url", ""), (7, None, "<p>loose <i>te</i>xt<p>more <")]
    pages += [pages[0], (None, "https://a.example.org/", "<main>m</main>")]
    got = html_extract.extract(table(spark, pages, COLUMNS))
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    by = dict(rows(got, "page_id", "text"))
    assert by[1] == "Headé 1 One bold. Two <3 x"
    assert by[2] == "Headé 2 a b"
    assert by[3] == "Headé 3 " + " ".join(" ".join(prose(k, 200).split()) for k in range(100))
    assert by[4] == "Headé 4"
    assert by[5] == by[6] == ""
    assert by[7] == "loose text more <"
    assert len(got.collect()) == len(pages)
    assert html_extract.extract(table(spark, [], COLUMNS)).collect() == []


def test_article_text_is_not_taken_for_template(spark):
    def pages(host, bodies, same_url=False):
        return [(i, f"https://{host}/{0 if same_url else i}", f"<body><article>{b}</article></body>") for i, b in enumerate(bodies)]

    def got(p):
        return dict(rows(html_extract.extract(table(spark, p, COLUMNS)), "page_id", "text"))

    alike = prose(1, 80)
    long = [f"{alike} {prose(i, 30)}" for i in range(2, 9)]
    assert got(pages("a", [f"<div>{t}</div>" for t in long])) == dict(enumerate(long))
    assert got(pages("b", ["<div>one page</div>"] * 6)) == dict.fromkeys(range(6), "one page")
    assert got(pages("c", ["<div>one page</div>"] * 6 + ["<div>one page</div><p>x</p>"], same_url=True))[0] == "one page"
    own = [prose(i, 30) for i in range(8)]
    assert got(pages("d", [f"<div>same box</div><p>p{i}</p><div>{t}</div>" for i, t in enumerate(own)])) == {i: f"p{i} {t}" for i, t in enumerate(own)}


def merged(*pages):
    """The wrapper's places by path of labels."""
    names, by = {}, html_extract.wrapper(pages)
    for p in pages:
        stack = [0]
        for kind, value, inline in html_extract.events(p):
            if kind == "open" and not inline:
                stack.append((stack[-1] * html_extract.PATH_BASE + html_extract.label_hash(value) + 1) % html_extract.PRIME)
                names[stack[-1]] = f"{names.get(stack[-2], '')}/{value}"
            elif kind == "close" and not inline:
                stack.pop()
    return {names.get(k, ""): x for k, x in by.items()}


def test_wrapper_has_optional_and_repeated_groups():
    pages = [f"<body><div><p>x{k}</p>{extra}</div></body>" for k, extra in ((1, "<p>y</p>"), (2, "<table><tr><td>1</table>"), (3, ""))]
    w = merged(*pages)
    p, t, d = w["/body/div/p"], w["/body/div/table"], w["/body/div"]
    assert (p.pages, p.once, p.most) == (3, 2, 2)
    assert (t.pages, t.most) == (1, 1)
    assert d.pages == 3 and len(d.texts) == 3
    for order in itertools.permutations(pages):
        assert {k: (x.pages, x.once, x.most, x.length, sorted(map(str, x.texts.items()))) for k, x in merged(*order).items()} == {k: (x.pages, x.once, x.most, x.length, sorted(map(str, x.texts.items()))) for k, x in w.items()}
    assert merged(pages[0], pages[0])["/body/div"].pages == 1


def test_a_place_counts_all_its_texts():
    """However many other texts stand in the place on each page, that of the template isn't missed."""
    pages = ["<body><div>fixed</div>" + "".join(f"<div>text {i} {k}</div>" for k in range(40)) + "</body>" for i in range(9)]
    texts = [t for p in html_extract.wrapper(pages).values() for t in p.texts.values()]
    assert max(t[0] for t in texts) == 9 and len(texts) >= 1 + 9 * 40


def test_the_wrapper_tells_template_from_content(spark):
    """Hosts of plain elements, where no label says what is main: the wrapper alone drops the menus and footers."""

    def got(pages):
        return dict(rows(html_extract.extract(table(spark, pages, COLUMNS)), "page_id", "text"))

    own = [prose(i, 40) for i in range(6)]
    plain = [(i, f"https://plain/{i}", f"<body><div><div><a>Home</a> <a>News {'' if i else 'x'}</a></div><div><b>All of us</b><p>since 1999</p></div></div><div><p>{t}</p><p>p{i}</p></div><table><tr><td>imprint</td></tr></table></body>") for i, t in enumerate(own)]
    expected = {i: f"{'Home News x ' if i == 0 else ''}{t} p{i}" for i, t in enumerate(own)}
    assert got(plain) == expected
    assert all(html_extract.main_text(p[2], frozenset(), frozenset()) != expected[p[0]] for p in plain)
    # equal pages and pages that differ by a stamp are no evidence; a passage on a few pages is none either
    same = [(i, f"https://same/{i}", f"<body><div><p>{own[0]}</p></div></body>") for i in range(8)]
    assert got(same) == dict.fromkeys(range(8), own[0])
    stamped = [(i, f"https://stamp/{i}", f"<body><div><p>{own[0]}</p></div><div>{i}</div></body>") for i in range(8)]
    assert got(stamped) == {i: f"{own[0]} {i}" for i in range(8)}
    quoted = [(i, f"https://quote/{i}", f"<body><article><p>{own[1] if i < 5 else own[2]}</p><p>{prose(50 + i, 60)}</p></article></body>") for i in range(8)]
    assert got(quoted) == {i: f"{own[1] if i < 5 else own[2]} {prose(50 + i, 60)}" for i in range(8)}
    # a box in an article, comments as articles, words that say nothing of a paragraph
    boxed = [(i, f"https://box/{i}", f"<body><article><p class='legal'>{t}</p><div>Join us now</div><p>p{i}</p></article><article class='comment'><p>{prose(90 + i, 9)}</p></article></body>") for i, t in enumerate(own)]
    assert got(boxed) == {i: f"{t} p{i}" for i, t in enumerate(own)}


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 50_000 + "deep"
    ends = "<div>" * 8000 + "text" + "</x>" * 8000
    got = dict(rows(html_extract.extract(table(spark, [(1, "https://d/1", deep), (2, "https://d/2", ends)], COLUMNS)), "page_id", "text"))
    assert got == {1: "deep", 2: "text"}


def test_warc_round_trip(spark):
    big, other = prose(1, 400), prose(2, 400)
    pages = [(1, "http://x/1", big), (2, "http://x/2", big), (3, "http://x/3", big), (4, None, "small"), (5, "http://x/5\r\nA: b", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (9, "ü", "Ä" * 200_000), (9, "ü", "Ä" * 200_000), (2, "http://x/2", big)]
    got = warc.archived(table(spark, pages, COLUMNS))
    last = {big: 3, other: 8, "Ä" * 200_000: 9}
    want = []
    for i, _, h in pages:
        h = h or ""
        revisit = len(h.encode()) >= 1000 and i is not None and i < last[h]
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archived(table(spark, [], COLUMNS)).collect() == []


def test_archive_is_a_dictionary_and_a_frame_for_each_record(spark):
    out = io.BytesIO()
    a = warc.Archive(out)
    recs = [warc.record(i, f"http://x/{i}", prose(i, 300).encode(), hashlib.sha1(prose(i, 300).encode()).hexdigest(), None, len(prose(i, 300))) for i in range(1500)]
    for r in recs:
        a.add(r)
    a.close()
    data = out.getvalue()
    assert data[:4] == warc.MAGIC.to_bytes(4, "little")
    assert list(warc.records(io.BytesIO(data))) == recs
    assert warc.parsed(recs[3])["payload"] == prose(3, 300).encode()
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-5])))
    spark  # noqa: B018
    assert new_path(spark, "x") != new_path(spark, "x")
