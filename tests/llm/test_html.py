import random

import pytest

from tallyframe.llm import html_wrapper as hw


def text(page):
    return hw.blocks(hw.parse(page))


@pytest.mark.parametrize("page, blocks", [
    ("<p>a<p>b <i>c</i><br>d&nbsp;&amp;&lt;x", ["a", "b c d &<x"]),
    ("<html><body><nav>m</nav><article><h1>T</h1><p><b>one.<br><p>two\n  three</article><footer>f</footer>", ["T", "one.", "two three"]),
    ("<div class='sidebar'>s</div><div>main <span class='ad'>buy</span>text</div>", ["main text"]),
    ("<ul><li>x<li>y<ul><li>z</ul></ul><script>if (a<b) '</p>'</script><style>p{}</style>", ["x", "y", "z"]),
    ("<article><h1>A</h1><p>b</p><div class='share-buttons'>s</div><form><p>f</p></form><aside>n</aside></article><div id='comments'><article>c</article></div>", ["A", "b"]),
    ("<main><p>m</p></main><p>out</p>", ["m"]),
    ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", ["yes"]),
    ("<p title='a>b'>q</p><p title='open>r</p>", ["q", "r"]),
    ("a < b and <3", ["a < b and <3"]),
    ("<p>cut <b", ["cut"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<header>top</header><article><header><h1>H</h1></header><p>x</p></article>", ["H", "x"]),
    ("<textarea><p>t</p></textarea><title>no</title><p hidden>h</p><p style='display: none'>n</p>ok", ["ok"]),
    ("<body class='post'><div>menu text</div><div id='main'><p>t</p><div class='entry-content'><p>long enough story</p></div></div>", ["long enough story"]),
    ("<div class='site no-sidebar'><article><p>text</p></article></div>", ["text"]),
    ("<div class='layout has-sidebar'><p>text</p></div><div class='sidebar'>s</div>", ["text"]),
    ("<div class='site sidebar'><article><p>text</p></article></div>", ["text"]),
    ("<article><section class='related-work'><p>r</p></section><div class='notice-period'>n</div><p class='replying'>a</p></article>", ["r", "n", "a"]),
    ("<form id='all'><div>a long page of a form that holds all</div></form><nav>menu</nav>", ["a long page of a form that holds all"]),
    ("<p>t <a class='share' href='x'>send</a><a href='y'>kept</a></p>", ["t kept"]),
    ("", []), (None, []), ("   ", []), ("<nav>only</nav>", []),
])
def test_blocks(page, blocks):
    assert text(page) == blocks


def test_deep_nesting_and_long_pages():
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == ["deep"]
    assert len(text("<p>word</p>" * 30_000)) == 30_000
    assert text("<a b=\"" * 3000 + "x") == []
    assert text("x<" * 20_000) == ["x"]
    assert text("<div>" * 3000 + "<nav>menu</nav><p>deep</p>" + "</div>" * 3000) == ["deep"]
    page = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    a, b = hw.wrapper_of(hw.skeleton(hw.parse(page))), hw.parse(page.replace("<p>", "<h1>t</h1><p>"))
    assert len(hw.aligned(a, b)) == 3002


def sizes(node):
    return 1 + sum(map(sizes, node.nodes))


def by_definition(a, b):
    if a.label != b.label:
        return 0
    if a.label.endswith("*"):
        return 1
    x, y = a.nodes, b.nodes
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + by_definition(x[i], y[j]))
    return best[-1][-1] + 1


def tree(rng, depth):
    tag = rng.choice(["div", "section", "blockquote"])
    inner = "".join(tree(rng, depth - 1) for _ in range(rng.randrange(4))) if depth else "t"
    return f"<{tag}>{inner}</{tag}>"


@pytest.mark.parametrize("cells", [hw.CELLS, 1])
def test_simple_tree_matching(monkeypatch, cells):
    monkeypatch.setattr(hw, "CELLS", cells)
    rng = random.Random(6)
    for _ in range(60):
        a, b = (hw.parse(f"<body>{tree(rng, 3)}{tree(rng, 2)}</body>") for _ in range(2))
        pairs = hw.aligned(a, b)
        assert hw.matching(a, b, {}) == by_definition(a, b) == len(pairs)
        assert all(p.label == q.label for p, q in pairs) and len({id(q) for _, q in pairs}) == len(pairs)
        assert len(hw.aligned(hw.wrapper_of(hw.skeleton(a)), b)) == len(pairs)
    assert len(hw.aligned(a, a)) == sizes(a) == a.size


def test_many_children_are_matched_exactly():
    rng = random.Random(7)
    x, y = ("".join(rng.choice(["<div>a</div>", "<section>b</section>", "<blockquote><p>c</blockquote>"]) for _ in range(700)) for _ in range(2))
    a, b = hw.parse(x), hw.parse(y)
    best = [0] * (len(b.nodes) + 1)
    for p in a.nodes:
        row = [0]
        for j, q in enumerate(b.nodes):
            row.append(max(row[j], best[j + 1], best[j] + (p.size if p.label == q.label else 0)))
        best = row
    assert hw.matching(a, b, {}) == 1 + best[-1] == len(hw.aligned(a, b))


def pages(spark):
    site = lambda i: f"<html><body><div>Home | About</div><div>{'<div>Extra</div>' if i % 3 == 0 else ''}<p>Story number {i} is its own.</p><p>Second {i * 7} part.</p></div><div>All rights kept</div></body></html>"
    rows = [(i, f"http://Site.example:80/{i}?x", site(i)) for i in range(12)]
    rows += [(100 + i, "https://copies.example/", "<div>Same page</div><div>again</div>") for i in range(9)]
    rows += [(200, None, "<p>alone</p>"), (201, "http://x.example/", None), (202, "no host", ""), (203, "http://x.example/", "<div>" + "long " * 50_000 + "</div>"), (None, "http://y.example/", "<p>z")]
    return spark.createDataFrame([(*r, 1, "e") for r in rows], "page_id long, url string, html string, node int, template string")


@pytest.mark.parametrize("parts", [1, 3])
def test_constant_nodes_are_template(spark, parts):
    got = {r["page_id"]: r for r in hw.extract(pages(spark).repartition(parts, "page_id")).collect()}
    for i in range(12):
        story = f"Story number {i} is its own.\n\nSecond {i * 7} part."
        assert got[i]["text"] in (story, "Extra\n\n" + story) and got[i]["n_chars"] == len(got[i]["text"])
    assert {got[100 + i]["text"] for i in range(9)} == {"Same page\n\nagain"}
    assert (got[200]["text"], got[201]["text"], got[202]["text"], got[None]["text"]) == ("alone", "", "", "z")
    assert got[203]["n_chars"] == 249_999
    assert len(got) == 26


def unmarked(i, tag="div"):
    """A page whose menu, advert and footer vary and have no marks."""
    rng = random.Random(i)
    words = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(6))
    story = [words(8), *[words(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 6))]]
    body = "".join(f"<p>{x}</p>" for x in story[1:])
    page = f"<html><body><div><ul>{menu}</ul></div><div>{words(9)}</div><{tag}><h1>{story[0]}</h1>{body}<p>Same on every page.</p></{tag}><div>{words(7)}</div></body></html>"
    return page, "\n\n".join(story)


def test_slots_tell_the_article_without_marks(spark):
    made = [unmarked(i) for i in range(30)]
    rows = [(i, f"http://a.example/{i}", page) for i, (page, _) in enumerate(made)]
    odd = (99, "http://a.example/e", "<html><body><h2>Not found</h2><div>Try the search</div></body></html>")
    results = []
    for table in ([*rows, odd], [odd, *rows], [*rows[15:], odd, *rows[:15]]):
        for parts in (1, 4):
            found = hw.extract(spark.createDataFrame(table, "page_id long, url string, html string").coalesce(1).repartition(parts)).collect()
            results.append({r["page_id"]: r["text"] for r in found})
    assert all(r == results[0] for r in results)
    assert all(results[0][i] == story for i, (_, story) in enumerate(made))


def test_pages_of_the_test_data_without_their_marks(spark, sf_dir):
    """The same article is found if no tag and no class name tells it from menus, adverts and footers."""
    import re

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: r["text"] for r in hw.extract(table).collect()}
    bare = [(r["page_id"], f"http://host{r['page_id'] % 2}.example/", re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", r["html"]).replace(' class="ad"', "")) for r in table.collect()]
    got = {r["page_id"]: r["text"] for r in hw.extract(spark.createDataFrame(bare, table.schema)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)
