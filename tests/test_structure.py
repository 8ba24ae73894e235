"""Chunks of pages by structure against a plain statement of their rules, tables with spans, odd rows, facts and filings."""

import itertools
import random

import pytest

from quire.sources import routes, structure

PAGE = """<title>no</title><h1>Top</h1><p>alpha <b>beta</b><br>gamma</p><ul><li>one</li><li>two</li></ul><h2>Sub</h2>
<table><tr><th colspan=2>H</th><th>J</th></tr><tr><td rowspan=2>a</td><td>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>
<h2>Empty</h2><h2>Last</h2><pre>x = 1</pre><script>no()</script>tail &amp; end <h3>bare"""


def plain_chunks(html, tokens=structure.TOKENS, count=structure.proxy_tokens):
    """The rules once more, step by step on one page's items."""
    pieces = []
    for item in structure.outline(html, tokens, count):
        held, used = [], 0
        for text, size in item["units"]:
            if held and used + size > tokens - item["taken"]:
                pieces.append((item, held, used))
                held, used = [], 0
            held, used = [*held, text], used + size
        pieces.append((item, held, used))
    out = []
    for item, texts, used in pieces:
        table = item["kind"] == "table"
        text = "\n".join([*([item["head"]] if item["head"] else []), *texts]) if table else "".join(texts).rstrip(" ")
        last = out[-1] if out else None
        if last and not table and last["kind"] != "table" and last["path"] == item["path"] and last["used"] + used <= tokens - item["taken"]:
            last["texts"].append(text)
            last["used"] += used
        else:
            out.append({"kind": item["kind"], "path": item["path"], "texts": [text], "used": used})
    return [(i, "\n".join([*c["path"], *c["texts"]]), c["path"][-1] if c["path"] else None, c["kind"]) for i, c in enumerate(out)]


def chunks_of(spark, html, **kw):
    got = structure.chunk_pages(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id", **kw).orderBy("chunk_index").collect()
    return [(r.chunk_index, r.text, r.section_heading, r.content_type) for r in got]


def test_structure_of_a_page(spark):
    assert chunks_of(spark, PAGE) == [
        (0, "Top\nalpha beta gamma\none\ntwo", "Top", "text"),
        (1, "Top\nSub\nH | H | J\na | b | c\na | d | e", "Sub", "table"),
        (2, "Top\nEmpty", "Top", "section_header"),
        (3, "Top\nLast\nx = 1\ntail & end\nbare", "Last", "code"),
    ]
    assert [x[3] for x in chunks_of(spark, PAGE, types=("sec_text", "sec_table"))] == ["sec_text", "sec_table", "sec_text", "sec_text"]


def test_every_page_equals_the_plain_statement(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    for tokens in (40, 400):
        got = {}
        for r in structure.chunk_pages(pages, "page_id", tokens=tokens).collect():
            got.setdefault(r.page_id, []).append((r.chunk_index, r.text, r.section_heading, r.content_type))
        want = {p.page_id: plain_chunks(p.html, tokens) for p in pages.collect()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("tokens", [16, 40, 400])
def test_no_chunk_is_too_long_and_no_word_is_lost(spark, tokens):
    words = [f"w{i}" for i in range(3000)]
    rows = "".join(f"<tr><td>r{i}</td><td>{'v' * (i % 300)}</td></tr>" for i in range(400))
    html = f"<h1>Title</h1><p>{' '.join(words)}</p><p>{'z' * 5000}</p><table><thead><tr><td>No</td><td>What</td></tr></thead>{rows}</table>" + "".join(f"<p>p{i}</p>" for i in range(900))
    got = chunks_of(spark, html, tokens=tokens)
    assert got == plain_chunks(html, tokens)
    # a line break between joined items takes no token, so characters stay within four a token and one for each item
    assert all(sum(map(structure.proxy_tokens, text.split("\n"))) <= tokens for _, text, _, _ in got if text.count("\n") < 3)
    tables = [text for *_, text, _, kind in got if kind == "table"]
    assert len(tables) > 1 and all(t.startswith("Title\nNo | What\n") for t in tables)
    text = " ".join(t.replace("\n", " ") for _, t, _, _ in got)
    assert [w for w in text.split() if w[0] == "w"] == words and text.count("z") == 5000 and sum(text.count(f"p{i} ") > 0 for i in range(900)) >= 899
    assert text.count("v") == sum(i % 300 for i in range(400))


def test_grids(spark):
    assert structure.grid([[("a", 2, 2), ("b", 1, 1)], [("c", 1, 3)], [("d", 1, 1)]]) == [["a", "a", "b"], ["a", "a", "c"], ["d", "c"]]
    long = "x" * (structure.REPEATED_CHARS + 1)
    assert structure.grid([[(long, 2, 1)]]) == [[long, ""]]
    wide = structure.grid([[("a", 100, 65534)] * 50, *[[("b", 1, 1)]] * 5000])
    assert sum(map(len, wide)) <= (structure.SPANNED + 1) * 5050 + 1000 and sum(line.count("b") for line in wide) == 5000


def test_tables_in_other_shapes(spark):
    assert chunks_of(spark, "<table><caption>Cap</caption><tr><th>H</th></tr><tr><td>1<table><tr><td>in</td></tr></table></td></tr></table>") == [(0, "Cap\nH\n1 in", None, "table")]
    assert chunks_of(spark, "<table><tr><th>only</th></tr></table><table></table><p>x") == [(0, "only", None, "table"), (1, "x", None, "text")]
    assert chunks_of(spark, "a<table><td>never closed<td>b") == [(0, "a", None, "text"), (1, "never closed | b", None, "table")]
    # a head that takes more than half of the room is a row like others
    head = "h" * 900
    got = chunks_of(spark, f"<table><tr><th>{head}</th></tr>" + "<tr><td>cell</td></tr>" * 500 + "</table>")
    assert sum(head in text for _, text, _, _ in got) == 1 and sum(text.count("cell") for _, text, _, _ in got) == 500


def test_headings(spark):
    long = "l" * 201
    got = chunks_of(spark, f"<h1>A</h1><h3>C</h3><p>1</p><h2>B</h2><p>2</p><h1>{long}</h1><p>3</p>")
    assert got == [(0, "A\nC\n1", "C", "text"), (1, f"A\nB\n2\n{long}\n3", "B", "text")]
    assert chunks_of(spark, "<h2>x</h2><h1>y</h1>") == [(0, "x\ny", None, "section_header")]


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, "<p>a", 6), (1, "<p>a", 6), (None, "b", 7), (2, "", 8), (3, "<p> &nbsp; </p>", 9)]
    df = spark.createDataFrame(rows, "page_id long, html string, pieces int")
    got = structure.chunk_pages(df, "page_id").collect()
    assert sorted((r.page_id or 0, r.chunk_index, r.text) for r in got) == [(0, 0, "b"), (1, 0, "a"), (1, 0, "a")]
    assert structure.chunk_pages(df.where("false"), "page_id").count() == 0


def test_a_tokenizer_counts(spark):
    count = lambda text: len(text.split())
    got = chunks_of(spark, "<p>" + "</p><p>".join(["a b c"] * 5), tokens=6, count=count)
    assert [x[1] for x in got] == ["a b c\na b c", "a b c\na b c", "a b c"]


def test_facts_and_filings_keep_their_structure(spark):
    filing = "".join(f"<DOCUMENT>\n<TYPE>{t}\n<FILENAME>{n}\n<TEXT>\n{body}\n</TEXT>\n</DOCUMENT>\n" for t, n, body in [("10-K", "a.htm", PAGE), ("EX-1", "b.txt", "prose"), ("EX-2", "c.htm", "<h1>C</h1><p>third")])
    facts = f'<html xmlns:ix="{routes.files.INLINE_FACTS}"><h1>F</h1><p>text<table><tr><td>1</td></tr></table>'
    rows = [("x\ny.txt", bytearray(("<SEC-DOCUMENT>\n" + filing).encode()), "text"), ("f.htm", bytearray(facts.encode()), "html")]
    out = routes.chunks(routes.with_routes(spark.createDataFrame(rows, "path string, content binary, type string"))).collect()
    got = {p: [(r.chunk_index, r.section_heading, r.content_type) for r in g] for p, g in itertools.groupby(sorted(out, key=lambda r: (r.path, r.chunk_index)), key=lambda r: r.path)}
    assert got == {
        "f.htm": [(0, "F", "sec_text"), (1, "F", "sec_table")],
        "x\ny.txt": [(0, "Top", "text"), (1, "Sub", "table"), (2, "Top", "section_header"), (3, "Last", "code"), (4, None, None), (5, "C", "text")],
    }


MARKUP = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<td rowspan=2>", "<td colspan='3' x>", '<th COLSPAN="2"\n rowspan=2 >', "<thead>", "</thead>", "<tr class=a>", "<TD>", "<td colspan=2/>", "<td/>", "<br/>", "<p>", "</p>", "<h1>", "</h1>", "<h2 id=a/b>", "</h2>", "a", " b ", "x  y", "\n", "&amp;", "&lt", "\xa0", "<", "<!--c-->", "<!-- a > b -->", "<!--x", "<!DOCTYPE html>", "<?pi?>", "<script>", "</script>", "<script>if (a < b) x</script>", "<style>td {}</style>", "<style><!-- <p> --></style>", "<title>t</title>", "<textarea>", "<pre>", "<li>", "<a href='x", "<a b = 'y > z'>", ">", "</>", "</ p>", "<td rowspan=&#50;>", "\x1c", "<t\x0bd>", "<tr><td>1</td><td> 2</td></tr>", "<tr><td>1</td></tr><tr><td>&lt;b</td><td></td></tr>", "<tr><th>h</th>\n<td> k </td></tr> <tr><td colspan=2>z</td></tr>", "<td colspan=2 colspan=3>", "<td\xe9>"]


def test_plain_markup_is_read_as_by_the_standard_parser(monkeypatch):
    def items(html):
        parser = structure._Items(lambda text: len(text) < 9)
        parser.feed(html)
        return parser.done()

    rng = random.Random(5)
    pages = ["".join(rng.choices(MARKUP, k=rng.randint(1, 20))) for _ in range(4000)]
    pages = [PAGE, *(("<table>" if i % 2 else "") + p for i, p in enumerate(pages))]
    got = [items(p) for p in pages]
    with monkeypatch.context() as m:
        m.delattr(structure._Items, "feed")
        assert [items(p) for p in pages] == got
    # a page of plain markup does without that parser
    monkeypatch.setattr(structure.HTMLParser, "feed", None)
    head = "<thead><tr><td rowspan=2>Line</td><td colspan=2>What</td></tr><tr><td>Number</td><td>Sent</td></tr></thead>"
    assert items(f"<h1>Order</h1><table>{head}<tr><td>1</td><td>&lt;2</td><td></td></tr><tr><td>3</td></tr></table><p>x<br>y</p>") == [
        ("table", ["Order"], "", ["Line | What | What", "Line | Number | Sent"], ["1 | <2 | ", "3"]),
        ("text", ["Order"], "x y", [], []),
    ]


def test_items_by_columns_are_those_by_rows():
    pages = [structure.outline(h, 40) for h in (PAGE, "", "<p>" + "word " * 99)]
    got = structure.as_arrow(pages)
    assert got.to_pylist() == structure.pa.array(pages, type=got.type).to_pylist() and got.type == structure.pa.list_(structure.ITEM) and structure.as_arrow([]).to_pylist() == []
