"""Main text where many pages have no semantic element, and raw elements of any script."""

from __future__ import annotations

import random

from annospark.llm import html_content as hc

WORDS = "river town market boat summer bread water salt time road winter field stone house light paper".split()


def _pages() -> list[tuple[int, str, str, str]]:
    """page_id, url, html, main text; a third of the pages is of one host and all div."""
    pick, out = random.Random(3), []
    for i in range(90):
        say = lambda n: " ".join(pick.choice(WORDS) for _ in range(n)).capitalize() + "."
        body = [say(pick.randint(12, 40)) for _ in range(4)]
        text = "".join(f"<p>{x}</p>" for x in body)
        menu = "".join(f'<li><a href="/{k}">{pick.choice(WORDS)}</a></li>' for k in range(5))
        if i % 3:
            page = f"<nav><ul>{menu}</ul></nav><main><article>{text}</article></main><footer>&copy; {say(2)}</footer>"
        else:
            page = (f'<div class="menu"><ul>{menu}</ul></div><div class="content"><div class="story">{text}</div></div>'
                    f'<div class="footer">&copy; {say(2)}</div>')
        host = f"h{i}.example" if i % 3 else "hot.example"
        out.append((i, f"http://{host}/{i}", f"<html><body>{page}</body></html>", "\n".join(body)))
    return out


def test_pages_without_semantic_elements_keep_their_text(spark):
    rows = _pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in hc.extract(df).collect()}
    assert [i for i, _, _, text in rows if found[i] != text] == []


def test_sample_takes_labelled_pages_of_every_host(spark):
    rows = [(i, f"http://{'hot' if i < 60 else i}.example/", f"<main><p>{i}</p></main>") for i in range(70)]
    rows += [(100 + i, "http://div.example/", f"<div><p>{i}</p></div>") for i in range(30)]
    rows += [(200, "http://c.example/", '<div class="comments"><article class="comment"><p>Hi</p></article></div>'), (201, None, None)]
    df = spark.createDataFrame(rows + rows[:1] * 20, "page_id long, url string, html string")
    few = [r["html"] for r in hc.sampled(df, 12).collect()]
    assert len(few) == 12 and {f"<main><p>{i}</p></main>" for i in range(60, 70)} <= set(few)
    assert all("<main>" in x for x in few)


def test_raw_elements_end_where_they_end():
    for letters in ("İ" * 9, "İ" * 60, "ẞ" * 9):
        page = f"<p>{letters}</p><SCRIPT>var x = '<p>code</p>';</Script><p>Text one.</p><p>Two.</p>"
        assert [t for n in hc.parse(page) for _, t, _ in n.parts] == [letters, "Text one.", "Two."]


def test_formulas_and_object_fallbacks_are_text():
    page = ("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds, "
            "<object data='a.pdf'>see the paper</object> for it.</p>")
    nodes = hc.parse(page)
    assert [n.tag for n in nodes] == ["body", "p"]
    assert "".join(t for _, t, _ in nodes[1].parts) == "Energy E=mc2 holds, see the paper for it."
