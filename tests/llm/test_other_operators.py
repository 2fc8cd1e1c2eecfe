"""Tool calls, pages, mixing, components and the pipeline."""

import html as entities
import json
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from oracle_compare import compare, duck
from scopeforge.llm import mixture, tool_calls, wrapper_html
from scopeforge.llm.components import connected, forest
from scopeforge.llm.registry import ORACLES, QUERIES
from scopeforge.llm.wrapper_html import fold, learn, main_text, merge, begin_wrapper, stream


def test_queries_equal_their_sql(spark, sf_dir):
    con = duck(sf_dir)
    for name, sql in ORACLES.items():
        assert compare(spark, con, name, QUERIES[name], sql, sf_dir)["ok"], name


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"


def linked(spark, calls, results):
    schemas = spark.createDataFrame([("add", "a", "integer", True), ("add", "b", "number", False)],
                                    "name string, field string, type string, required boolean")
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)
    return rows.orderBy("conv_id", "position").collect()


def test_arguments_are_checked_and_canonical(spark):
    rows = linked(spark, [(1, 0, "x", "add", '{ "b" : 1.50, "a":2 }', None), (1, 1, "y", "add", '{"b":"q","c":1}', []),
                          (1, 2, "z", "sub", "{}", None), (1, 3, "w", "add", "{", None)], [(1, 4, "x", 'say "hi"')])
    assert rows[0].message == '{"arguments":{"a":2,"b":1.5},"id":"x","name":"add","type":"tool_call"}'
    assert [(r.call_id, r.status, r.problems) for r in rows] == [
        ("x", "ok", ""), ("y", "invalid_arguments", "missing:a,type:b,unknown:c"), ("z", "unknown_tool", None),
        ("w", "invalid_json", None), ("x", "ok", None)]
    assert rows[4].message == '{"content":"say \\"hi\\"","id":"x","type":"tool_result"}'


def test_messages_move_behind_what_they_need(spark):
    one = '{"a":1}'
    rows = linked(spark, [(1, 0, "a", "add", one, ["b"]), (1, 1, "b", "add", one, ["c"]), (1, 5, "c", "add", one, None)],
                  [(1, 2, "c", "r"), (1, 6, "b", "r"), (1, 7, "a", "r")])
    assert [(r.kind, r.call_id) for r in rows] == [("call", "c"), ("result", "c"), ("call", "b"), ("result", "b"),
                                                    ("call", "a"), ("result", "a")]


def test_cycles_are_reported(spark):
    one = '{"a":1}'
    rows = linked(spark, [(1, 0, "a", "add", one, ["b"]), (1, 1, "b", "add", one, ["a"]), (2, 0, "a", "add", one, None)], [])
    assert {(r.conv_id, r.call_id): r.status for r in rows} == {(1, "a"): "cycle", (1, "b"): "cycle", (2, "a"): "no_result"}


def plain(page):
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_pages_against_a_plain_reading(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()}
    for r in QUERIES["op9_wrapper_html"](spark, sf_dir).collect():
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def test_repeats_fold_and_differences_become_slots():
    pages = [f"<div><h1>T{i}</h1><ul>{'<li>x</li>' * (i + 2)}</ul><p>same</p>{'<em>e</em>' if i else ''}</div>" for i in range(3)]
    wrapper = begin_wrapper(fold(stream(pages[0])))
    for page in pages[1:]:
        wrapper = merge(wrapper, fold(stream(page)))
    kinds = [w[0] for w in wrapper]
    assert kinds.count("+") == 1 and ["x", None, False] in wrapper and ["x", "same", False] in wrapper
    assert ["t", "em", True] in wrapper


def test_template_text_is_left_out_where_no_element_tells():
    page = "<body><div><div>Always here</div><div>Story {0} begins</div><div>and {0} ends</div></div></body>"
    learned = learn([page.format(i) for i in range(6)])
    assert main_text(page.format("x"), learned) == "Story x begins\nand x ends"


def test_template_is_confirmed_by_all_pages_of_a_host(spark, tmp_path):
    page = "<body><h2>Top</h2><div>{0}</div><h1>Story {1} begins</h1><p>and {1} ends</p><pre>by {1}</pre></body>"
    rows = [(i, "http://h.x/a", page.format("Mild today" if i != 70 else "Storm today", i)) for i in range(100)]
    # copies of one page are one page; of the other host all pages hold the text
    rows += [(i, "http://h.x/b", page.format("Mild today", "copied")) for i in range(100, 200)]
    rows += [(i, "http://k.x/a", page.format("Mild today", i)) for i in range(200, 220)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["op9_wrapper_html"](spark, str(tmp_path)).collect()}
    for i, url, html in rows:
        name = "copied" if 100 <= i < 200 else i
        told = "" if i >= 200 else "Storm today\n" if i == 70 else "Mild today\n"
        assert got[i] == f"{told}Story {name} begins\nand {name} ends\nby {name}", i


@pytest.mark.parametrize("part", [4, 128])
def test_form_of_a_wrapper_comes_from_all_pages_of_a_host(spark, monkeypatch, part):
    """What one page of many lacks is in no wrapper, however the pages are dealt to tasks."""
    monkeypatch.setattr(wrapper_html, "PART", part)
    page = "<body>{1}<div>Always here</div><ul>{2}</ul><h1>Story {0} begins</h1><p>and {0} ends</p><pre>by {0}</pre></body>"
    rows = [(i, "http://h.x/a", page.format(i, "" if i == 70 else "<h2>Top</h2>", f"<li><a>{i}</a></li>" * (2 + i % 3)))
            for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    learned, = [json.loads(r.learned) for r in wrapper_html.wrappers(pages).collect()]
    tags = [w[1] for w in learned["wrapper"] if w[0] == "t"]
    assert "h2" not in tags and "div" in tags and not any(w[2] for w in learned["wrapper"])
    assert [w[0] for w in learned["wrapper"]].count("+") == 1
    for r in wrapper_html.extract(pages).collect():
        items = [str(r.page_id)] * (2 + r.page_id % 3)
        assert r.text == "\n".join([*([] if r.page_id == 70 else ["Top"]), *items, f"Story {r.page_id} begins",
                                    f"and {r.page_id} ends", f"by {r.page_id}"])


def test_text_other_than_the_templates_is_kept():
    page = "<body><h2>{1}</h2><h1>Story {0} begins</h1><p>and {0} ends</p></body>"
    learned = learn([page.format(i, "Always here") for i in range(6)])
    assert main_text(page.format("x", "Only here"), learned) == "Only here\nStory x begins\nand x ends"


def test_marked_parts_are_left_out():
    page = ("<header>h</header><div class='cookie-notice'>c</div><main><h1>A &lt;b</h1><p>one  two<br>three<p>four <i>x</i>y"
            "<div id=comments><p>no</p></div></main><aside>s</aside><form>f</form><script>var t='</p>'</script>")
    assert main_text(page, None) == "A <b\none two three\nfour xy"


def test_what_an_article_holds_stays():
    """Equal on all pages or marked on a piece of prose: inside an article it is text."""
    pages = [f"<body><div>Same</div><article><h1>Story {i}</h1><div class='by'>By our staff</div><p>Body {i} a</p><p>Body {i} b</p>"
             f"<h2>Part {i}</h2><p class='share'>Profit per share rose</p><div class='ad'>Buy {i}</div></article></body>" for i in range(30)]
    learned = learn(pages)
    assert learned["template"]
    assert main_text(pages[3], learned) == "Story 3\nBy our staff\nBody 3 a\nBody 3 b\nPart 3\nProfit per share rose"


def test_unmarked_menu_that_never_changes_is_left_out():
    """A repeated group is compared as a whole; where one page has another item, its own stays."""
    menu = "<ul><li><a>Home</a></li><li><a>News</a></li><li><a>Sport</a></li></ul>"
    pages = [f"<body>{menu}<div><p>Text {i} one</p><p>Text {i} two</p></div></body>" for i in range(30)]
    learned = learn(pages)
    assert main_text(pages[7], learned) == "Text 7 one\nText 7 two"
    other = pages[7].replace("Sport", "Other")
    assert main_text(other, learned).startswith("Home\nNews\nOther")
    changing = learn([*pages, other])
    assert main_text(pages[7], changing) == "Home\nNews\nSport\nText 7 one\nText 7 two"


def test_long_repeats_fold():
    """Bodies of more items than any fixed number, inner repeats first."""
    body = [("t", f"a{i}") for i in range(70)]
    assert fold(body * 3) == [("+", [body, body, body])]
    inner = [("t", "ul"), ("t", "li"), ("t", "li"), ("t", "/ul")]
    folded = fold(inner * 2)
    assert folded == [("+", [[("t", "ul"), ("+", [[("t", "li")], [("t", "li")]]), ("t", "/ul")]] * 2)]


def test_marks_in_other_words():
    page = "<body><div><p>Text</p></div>" + "".join(
        f"<div class='{c}'><p>x</p></div>" for c in ("subscription-box", "breadcrumb-trail", "cookiebar", "kommentare", "werbung")) + "</body>"
    assert main_text(page, None) == "Text"


def test_marks_do_not_take_the_article():
    story = "<h1>Head</h1><p>one two three</p>"
    for page in ("<article class='post no-sidebar'>{}</article>", "<div class='site right-sidebar'><article>{}</article></div>",
                 "<div class='layout sidebar'><main>{}</main></div>", "<div class='article-body has-ads'>{}</div>",
                 "<article><div class='entry-header'><h1>Head</h1></div><p>one two three</p></article>",
                 "<main><div class='banner'><article>{}</article></div></main>", "<article class='related'>{}</article>",
                 "<form><div class=top>{}</div></form>", "<form><article>{}</article></form>", "<div class=widget>{}</div>"):
        assert main_text(page.format(story), None) == "Head\none two three", page
    # marks still count beside the article, also on articles' comments
    rest = ("<div class='right-sidebar sidebar'>s</div><div id=related-posts><article>r</article></div><form><p>f</p></form>"
            "<div class=site-footer>f</div><section class=comments><article class=comment>c</article></section>")
    assert main_text(f"<article>{story}{rest}</article>{rest}", None) == "Head\none two three"
    assert main_text(f"<div class=page>{story}{rest.replace('article', 'div')}</div>", None) == "Head\none two three"


def test_mix_comes_near_targets_and_repeats_alike(spark, sf_dir):
    rows = QUERIES["op10_mix_sources"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    first, again = rows.join(docs, "doc_id").collect(), rows.join(docs, "doc_id").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    by = {}
    for r in first:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 4 * mixture.BLOCK_WORDS for taken, target in by.values())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    a, b = np.array(edges).T
    node, label = forest(a, b)
    assert {n: lab for n, lab in zip(node.tolist(), label.tolist()) if n != 200} == got


def test_pipeline_keeps_one_of_each_group_and_reruns_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from scopeforge.session import materialize
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[1] <= kept[0] and kept[2] < kept[1] and kept[3] <= kept[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == kept[-1]


def test_documents_that_mix_languages_stay(spark, sf_dir):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang IS NOT NULL")
    # a stretch of each of the four languages in turn
    parts = docs.filter("size(split(text, ' ')) > 90").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).orderBy("lang").collect()
    assert len(parts) == 4
    mixed = " ".join(" ".join(r["text"].split()[i:i + 15]) for i in range(0, 90, 15) for r in parts)
    more = docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit(mixed)).withColumn(
        "lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs.unionByName(more), sf_dir)
    assert [r.text for r in kept.filter("doc_id = -1").collect()] == [mixed]
