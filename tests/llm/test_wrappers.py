"""Main text of pages whose article is known because the page was made around it."""

from __future__ import annotations

import html
import random
import re

import pytest

from returnlens.llm import wrappers

SCHEMA = "page_id long, url string, html string"
WORDS = "casa rio tempo vento & fogo <luz> pedra “mar” céu lua sol".split()


def sentence(pick, least=4, most=25):
    return " ".join(pick.choice(WORDS) for _ in range(pick.randint(least, most)))


def block(tag, text, pick):
    inner = html.escape(text, quote=False)
    if pick.random() < 0.3:
        first, _, rest = inner.partition(" ")
        inner = f"<b class=x>{first}</b> {rest}<!-- <p>no</p> -->"
    return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and pick.random() < 0.3 else f"</{tag}>")


def semantic(pick, blocks):
    body = "".join(block(t, x, pick) for t, x in blocks)
    return f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
<header><a href="/">Site</a><p>The best site of all sites</p></header><nav><ul>{''.join(f'<li><a href="/{i}">{sentence(pick, 1, 2)}</a></li>' for i in range(pick.randint(3, 7)))}</ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div><main><article>{body}
<div class="ad">{html.escape(sentence(pick))}</div></article><section class="comments"><p>{html.escape(sentence(pick, 30, 60))}</p></section></main>
<aside><p>{html.escape(sentence(pick))}</p></aside><form action=x><p>Name <input name=n></p></form><footer><p>Imprint</p></footer></body></html>"""


def plain(pick, blocks):
    body = "".join(block(t, x, pick) for t, x in blocks)
    links = "".join(f'<div><a href="/{i}">{sentence(pick, 2, 4)}</a></div>' for i in range(pick.randint(2, 9)))
    return f"""<body><div id=top-{pick.randint(1, 99)}><div class=logo>Daily</div></div><div class=left>{links}</div>
<div class=center><div class=inner>{body}</div></div><div class=right>{html.escape(sentence(pick, 3, 8))}</div><div class=bottom>All rights</div>"""


def article(pick):
    blocks = [("h1", sentence(pick, 2, 5))]
    for _ in range(pick.randint(2, 8)):
        blocks.append((pick.choice(("p", "p", "p", "h2", "blockquote")), sentence(pick, 15, 60)))
    return blocks


def made(seed=12, many=40):
    pick = random.Random(seed)
    rows, want = [], {}
    for i in range(many):
        kind = pick.choice((semantic, plain))
        blocks = article(pick)
        host = "Sem.Example.org" if kind is semantic else "user@plain.example.org:8080"
        rows.append((i, f"https://{host}/a?{i}", kind(pick, blocks)))
        want[i] = "\n".join(" ".join(x.split()) for _, x in blocks)
    return rows, want


def texts(df):
    return {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()}


def test_known_articles(spark):
    rows, want = made()
    for parts in (1, 5):
        got = texts(spark.createDataFrame(rows, SCHEMA).repartition(parts))
        assert got == want


def test_many_tasks_and_hosts(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    monkeypatch.setattr(wrappers, "HOSTS_HELD", 1)
    rows, want = made(5, 60)
    assert texts(spark.createDataFrame(rows, SCHEMA).repartition(20)) == want


def test_odd_rows(spark):
    pick = random.Random(3)
    page = semantic(pick, [("h1", "Title"), ("p", "Some text that is long enough")])
    long_text = " ".join(f"word{i}" for i in range(60000))
    rows = [(1, "http://a.org", None), (2, None, ""), (3, None, "<p>One &amp; two&nbsp; three &#x41;<br>x<p>4 < 5 > 3</div>"), (4, "no url", "bare text"), (None, "http://a.org", page),
            (5, "http://a.org", page), (5, "http://a.org", page), (6, "http://long.org", f"<html><article><p>{long_text}</p></article>"), (7, "http://d.org", "<div>" * 3000 + "deep <p>text" + "</div>" * 3000),
            (8, "http://e.org", "<script>alert(1)"), (9, "http://f.org", "<p title='a>b' class=\"x>y\">quoted <i>words</i>here</p><TABLE><TR><TD>a<TD>b</TABLE>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' AS host", "'w' AS wrapper", "1 AS spot", "2 AS n", "'t' AS text")
    got = wrappers.extract_main_text(df).orderBy("page_id").collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[8] == "" and by_id[3] == "One & two three A x\n4 < 5 > 3" and by_id[4] == "bare text"
    assert by_id[5] == by_id[None] == "Title\nSome text that is long enough"
    assert by_id[6] == long_text and by_id[7] == "deep\ntext" and by_id[9] == "quoted wordshere\na\nb"
    assert wrappers.extract_main_text(df.where("false")).count() == 0


def test_copies_on_one_host_stay(spark):
    pick = random.Random(8)
    page = semantic(pick, [("h1", "Copied"), ("p", "The same article on every page of the host")])
    assert set(texts(spark.createDataFrame([(i, "http://c.org/x", page) for i in range(12)], SCHEMA)).values()) == {"Copied\nThe same article on every page of the host"}


def test_constants_of_a_host_go(spark):
    pick = random.Random(9)
    rows, want = [], {}
    for i in range(10):
        text = sentence(pick, 20, 40)
        rows.append((i, "http://k.org", f"<div class=page><div class=text><h1>Story {i}</h1><p>{html.escape(text)}</p></div><div class=tail>Printed on paper</div></div>"))
        want[i] = f"Story {i}\n" + " ".join(text.split())
    assert texts(spark.createDataFrame(rows, SCHEMA)) == want


def test_alignment_makes_optional_and_repeated_groups():
    one, _ = wrappers.read_page("<nav><ul><li>a</ul></nav><div class=ad>x</div><article><h1>t</h1><p>a<p>b</article>")
    two, _ = wrappers.read_page("<nav><ul><li>b<li>c</ul></nav><article><h1>u</h1><p>c</article><footer>f</footer>")
    merged = wrappers._bare(one)
    wrappers._merge(merged, wrappers._bare(two), False)
    assert [(p[0], p[1]) for p in merged[3]] == [("nav", 2), ("div ad", 1), ("article", 2), ("footer", 1)]
    paragraph = next(p for p in merged[3][2][3][0][3] if p[0] == "p")
    assert paragraph[1] == 3 and paragraph[2]
    assert wrappers.aligned(list("abcde"), list("axcye")) == [(0, 0), (1, None), (None, 1), (2, 2), (3, None), (None, 3), (4, 4)]


def test_the_given_pages(spark):
    """The pages table wraps its article in one element; its paragraphs, without markup, are the text."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    got = texts(rows)
    for r in rows.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|li|ul|div)>", inner)
        clean = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in clean if x)
