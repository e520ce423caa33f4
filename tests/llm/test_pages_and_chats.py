from __future__ import annotations

import os
import random
import re
from hashlib import sha256
from html import unescape

import pyarrow.parquet as pq
import pytest

from plumbrule.llm import chat_format, html_extract, queries
from tests.llm.conftest import SF

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>x</a></ul></nav>
<div class="wrap"><div id="content"><h2>Title &amp; more</h2><p>First,  long enough,
 with <b>bold</b>,<br>and commas, to score.<p>Short.<ul><li>one<li>two</ul><div class="ad-box"><p>Buy, now, this, and, that, today.</p></div>
<p>Last&nbsp;&#233;&eacute; words.</p></div><div class="sidebar"><p>Side, bar, text, many, commas.</p></div>
<section id="comments"><p>I, agree, with, this, very, much, indeed, yes.</p></section><form><p>a,b,c</p></form></div>
<aside><p>x, y, z, w</p></aside><div style="display:none"><p>hidden, text</p></div><footer>f</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Title & more", "First, long enough, with bold, and commas, to score.", "Short.", "one", "two", "Last éé words."]


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\nb"), ("<script>x</script>", ""), ("<p> </p>", ""), ("</p></b><p>a</b>b</p>", "ab"),
    ("<article><h1>H</h1><p>x</article><article class='comment'><p>many, many, many words</article>", "H\nx"),
    ("<table><tr><td>a, b<td>c<tr><td>d</table>", "a, b\nc\nd"), ("<div>" * 3000 + "<p>deep, text</p>", "deep, text")])
def test_small_pages(html, text):
    assert html_extract.main_text(html) == text


LONG = "Words of an article, with commas, and enough of them, stand here. " * 3


@pytest.mark.parametrize("part, text", [
    ('<h2 class="section-header">Method</h2>', "Method"), ('<section class="discussion"><p>We discuss.</p></section>', "We discuss."),
    ('<p class="notice">Note that.</p>', "Note that."), ('<div class="alert"><p>Mind the gap.</p></div>', "Mind the gap."),
    ('<h2>References</h2><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>', "References\nOne\nTwo\nThree"),
    ('<div class="banner"><a href=1>Go</a></div>', ""), ('<div class="signup"><p>Write in:<form><input></form></p></div>', ""),
    ('<div class="related-posts"><p>More, of, this.</p></div>', ""), ('<p class="ad">Buy.</p>', ""), ('<p class="market-share">Up.</p>', "Up."),
    ('<div class="comments"><p>I, like, it.</p></div>', ""), ("loose text", "loose text"), ('<div hidden>no</div>', "")])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', "<div><div>{}</div></div>"])
def test_parts_of_an_article(wrap, part, text):
    page = f"<nav><a href=0>Home</a></nav>{wrap.format(f'<p>{LONG}</p>{part}<p>{LONG}</p>')}<footer>f</footer>"
    assert html_extract.main_text(f"<body>{page}</body>") == "\n".join(x for x in (LONG.strip(), text, LONG.strip()) if x)


@pytest.mark.parametrize("page, text", [
    ("<main><div>" + f"<p>{LONG}</p>" * 30 + "</div><div><p>Short end.</p></div></main>", "\n".join([LONG.strip()] * 30 + ["Short end."])),
    ("<div>" + f"<p>{LONG}</p>" * 30 + "</div><div><p>Short end.</p></div>", "\n".join([LONG.strip()] * 30 + ["Short end."])),
    (f"before <div><p>{LONG}</p><p>{LONG}</p></div> after", "\n".join(["before", LONG.strip(), LONG.strip(), "after"])),
    (f"<div><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>{LONG}</p></div>", LONG.strip()),
    (f"<div><div><a href=1>Menu</a> <a href=2>Shop</a></div><div><p>{LONG}</p></div></div>", LONG.strip())])
def test_what_surrounds_the_container(page, text):
    assert html_extract.main_text(f"<body><nav>n</nav>{page}<div class=sidebar><p>Side, bar.</p></div></body>") == text


def test_long_page_and_no_pages(frame):
    many = "".join(f"<p>Paragraph {k}, long.</p>" for k in range(20_000))
    assert html_extract.main_text(f"<article>{many}</article>").count("\n") == 19_999
    assert html_extract.extract_main_text(frame([], "page_id long, url string, html string")).collect() == []


def gold(html: str) -> str:
    """The article of a generated page, by its tags alone."""
    inner = re.search(r"<article>(.*)</article>", html, re.DOTALL)[1]
    blocks = [re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split(r"</?(?:p|h1|h2|ul|li|article)>", inner)]
    return "\n".join(t for t in (" ".join(unescape(x).split()) for x in blocks) if t)


@needs_data
@pytest.mark.parametrize("opened, closed", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ("<div>", "</div>"),
                                            ("<div><section>", "</section></div>")])
def test_gold_texts_of_the_tables(opened, closed):
    """The generated kinds of pages, and the same with other elements around the article: word precision and recall of each are 1."""
    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()
    for html in pages:
        assert html_extract.main_text(html.replace("<article>", opened).replace("</article>", closed)) == gold(html)


def test_pages_with_odd_columns(frame):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "<p>x</p>", 3), (1, "u", PAGE, 1)]
    got = html_extract.extract_main_text(frame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(str(r.page_id) for r in got if r.text) == ["1", "1", "None"]


@needs_data
def test_pages_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.registry.queries["op9_html_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert "track(" not in r.text and "©" not in r.text and r.text
        assert r.text.count("\n") + 1 <= pages[r.page_id].count("<p>") + 1


def expected(rows):
    """The read-back columns but the last, from the turns themselves."""
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss),
                     sha256(loss.encode()).hexdigest())
    return out


def turns() -> list[tuple]:
    rng = random.Random(8)
    rows = [(c, t, ("system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"), "w " * rng.randrange(1, 60)) for c in range(6)
            for t in range(rng.randrange(1, 30))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " * (1 + t % 9)) for t in range(700)]
    rows += [(60, 0, "user", "<|turn|>a<|body|>\\<|end|>\n\\\\"), (60, 1, "assistant", "</s>[INST] \\ <| < |"), (61, None, None, None), (61, 3, "user", None),
             (61, 3, "user", None), (None, 1, "assistant", "x"), (62, 0, "assistant", "long " * 4000), (62, 1, "user", ""), (62, 2, "assistant", "<")]
    return rows


@pytest.mark.parametrize("budget, history", [(2048, 256), (120, 20), (30, 0)])
def test_chat_round_trip(frame, budget, history, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_BUDGETS", 8)
    rows = turns()
    df = frame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mask int")
    formatted = chat_format.format_windows(df, budget=budget, history=history)
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert {c: tuple(r)[1:5] for c, r in back.items()} == expected(rows)
    assert back[50].formatted_chars > sum(len(t) for c, _, _, t in rows if c == 50)
    windows = formatted.collect()
    for r in windows:
        own = chat_format.read_turns(r.formatted)
        # Only a window with a single turn of its own may be over the budget.
        assert r.n_tokens <= budget or len(own) == r.repeated + 1
    if budget == 120:
        later = [r for r in windows if r.conv_id in (1, 3, 5) and (r.segment, r.window) != (0, 0)]
        assert later and all(chat_format.read_turns(r.formatted)[0][0] == "system" for r in later)


@pytest.mark.parametrize("words, repeated", [([580], 1), ([300, 300], 2), ([1900], 1), ([580, 3000], 1), ([3000, 10], 0)])
def test_long_system_turns_stay(frame, words, repeated, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_BUDGETS", 4)
    system = [(1, k, "system", "w " * n) for k, n in enumerate(words)]
    rows = system + [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 8) for k in range(len(words), 600)]
    formatted = chat_format.format_windows(frame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()} == expected(rows)
    windows = [(r, chat_format.read_turns(r.formatted)) for r in formatted.collect()]
    later = [(r, own) for r, own in windows if own[r.repeated][0] != "system" and r.repeated]
    assert len({r.segment for r, _ in later}) > 1
    for r, own in later:
        assert r.n_tokens <= chat_format.BUDGET
        assert [t[:2] for t in own if t[0] == "system"] == [(role, text) for *_, role, text in system[:repeated]]


def test_escapes():
    for text in ("", "\\", "<|", "\\<|end|>", "a\\\\<||>", "</s><s>[INST][/INST]<<SYS>>", "<", "|>"):
        assert chat_format.unescaped(chat_format.escaped(text)) == text
        form, start, end = chat_format.rendered(text, text)
        assert chat_format.read_turns(form * 2)[1][:2] == (text, text) and chat_format.unescaped(form[start:end]) == text
    assert chat_format.format_windows is not None


def test_no_turns(frame):
    empty = frame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_windows(empty)).count() == 0


@needs_data
def test_chats_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.registry.queries["op5_chat_windows"](spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows)
