"""Main-text extraction, nearest neighbours and the pipeline on small tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm.op10_html import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name, here.</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy now, buy cheap, buy more. Buy again!</div>
<article><h1>A title</h1><p><b>First   line,<br><p>Second &eacute;&nbsp;line.</p><!-- no --><p>Third <i>with</i> parts.</p>
<div class="comments"><p>I liked it, thanks, a lot.</p></div><form><p>Mail, please</p></form></article>
<aside>Related, stories.</aside><footer>&copy; example</footer></body></html>"""


def test_op10_article():
    assert main_text(PAGE) == "A title\nFirst line,\nSecond é line.\nThird with parts."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text", "just text"),
    ("<body><nav>a, b</nav></body>", ""), ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<p>a &lt;b&gt; &#65;&#x42;", "a <b> AB"), ("<div><p>one.</p><p>two.</p></div>", "one.\ntwo."),
    ("<p title='a>b'>x</p>", "x"), ("<article><h1>h</h1>" + "<p>w.</p>" * 3000 + "</article>", "h" + "\nw." * 3000),
])
def test_op10_cases(page, text):
    assert main_text(page) == text


BODY = "".join(f"<p>Paragraph {i}, with words, and some more of them.</p>" for i in range(20))
LINES = "\n".join(f"Paragraph {i}, with words, and some more of them." for i in range(20))


@pytest.mark.parametrize("page,text", [
    (f"<article><h1>Title</h1><p class=lead>The lead, short.</p><div class=body>{BODY}</div><p>The end.</p></article>",
     f"Title\nThe lead, short.\n{LINES}\nThe end."),
    (f"<body><div id=page><h1>Title</h1><div class=body><div class=inner>{BODY}</div><p>The end, at last.</p></div></div></body>",
     f"Title\n{LINES}\nThe end, at last."),
    (f"<body><div><p>Before it, a part.</p></div><article>{BODY}</article><div><p>After it, a part.</p></div></body>",
     f"Before it, a part.\n{LINES}\nAfter it, a part."),
    (f"<main><p>An opening, short.</p><article><section><h2>Part</h2>{BODY}</section></article></main>",
     f"An opening, short.\nPart\n{LINES}"),
])
def test_op10_nothing_beside_the_body_is_lost(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("open_, close", [
    ("<main class='has-sidebar'>", "</main>"), ("<div class='content with-sidebar'>", "</div>"),
    ("<article class='post category-legal'>", "</article>"), ("<article class=related>", "</article>"),
    ("<div class='tag-search'>", "</div>"), ("<div class=social-science>", "</div>"), ("<div class='comments-open'>", "</div>"),
    ("<form action=x><div class=page>", "</div></form>"), ("<div class='social-share'><div class=search>", "</div></div>"),
])
def test_op10_a_name_does_not_drop_the_page(open_, close):
    small = "<div class=ad>Buy, now.</div><div class='with-ads related'><p>More, of that.</p></div><form>Mail, please</form>"
    for page in (f"<body>{small}{open_}<h1>Title</h1>{BODY}{close}</body>", f"<body>{open_}<h1>Title</h1>{small}{BODY}{close}</body>"):
        assert main_text(page) == f"Title\n{LINES}"


def test_op10_an_advert_longer_than_the_article_is_dropped():
    page = "<body><div class=ad>Buy now, buy cheap, buy more. Buy again, and then buy once more!</div>{}<h1>A title.</h1><p>Text, short.</p>{}</body>"
    assert main_text(page.format("<article>", "</article>")) == "A title.\nText, short."


def test_op10_a_part_with_a_state_word_stays():
    page = f"<body><div class=page><div>{BODY}</div><div class='part with-sidebar'><p>One, two, three more.</p></div></div></body>"
    assert main_text(page) == f"{LINES}\nOne, two, three more."


MENU = "<div><ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8)) + "</ul></div>"
ADVERT, FOOT = "<div><a href=/x>Cheap watches here, today</a></div>", "<div><span>2024 Example Corp</span></div>"


@pytest.mark.parametrize("page", [
    f"<body>{MENU}{ADVERT}<div><h1>Title</h1>{BODY}</div>{FOOT}</body>",
    f"<body>{MENU}<h1>Title</h1>{BODY}{ADVERT}{FOOT}</body>",
    f"<body><div>{MENU}</div><div><section><h1>Title</h1>{BODY}</section></div><div>{FOOT}{ADVERT}</div></body>",
])
def test_op10_parts_without_telling_names_are_dropped_by_their_ratios(page, monkeypatch):
    from seqspark.llm import op10_html as M
    assert main_text(page) == f"Title\n{LINES}"
    real = M.path_scores
    monkeypatch.setattr(M, "path_scores", lambda paths, nodes, width=1: (
        [float(s > 0) for s in real(paths, nodes, width)[0]], *real(paths, nodes, width)[1:]))
    assert main_text(page) != f"Title\n{LINES}"                    # a constant score keeps what the ratios drop


def twin_scores(nodes):
    """Ratios over tuple paths, step by step: {path: score}."""
    order = list(dict.fromkeys(p for p, _, _ in nodes))
    texts = {p: [t for q, _, t in nodes if q == p] for p in order}
    r = [sum(len(t.strip()) for t in texts[p]) / len(texts[p]) for p in order]
    q = [sum(t.count(c) for t in texts[p] for c in ".,;:!?…。，、！？；：") / len(texts[p]) for p in order]
    out = {}
    for k, p in enumerate(order):
        near = range(max(0, k - 1), min(len(order), k + 2))
        a, b = ((sum(x[i] for i in near) / len(near) + 3 * x[k]) / 4 for x in (r, q))
        prior = 1.0
        for name, mark, _ in p:
            prior *= 0 if mark == "!" else 0.25 if mark == "?" else {"p": 2, "blockquote": 2, "pre": 2, "a": 0.1}.get(name, 1)
        out[p] = a * (1 + b) * prior if r[k] else 0.0
    return out, {p: r[k] * len(texts[p]) for k, p in enumerate(order)}


def test_op10_ratios_and_selection_equal_a_plain_twin():
    import random
    from seqspark.llm.op10_html import content_container, path_scores, text_nodes, threshold
    rng = random.Random(2)
    tags = ["div", "p", "a", "b", "ul", "li", "section", "h2", "div class=ad", "nav", "article", "span"]

    def piece(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(["word", "longer,", "words.", "x", "!"]) for _ in range(rng.randint(1, 12)))
        tag = rng.choice(tags)
        inner = "".join(piece(depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"
    for _ in range(150):
        page = "<body>" + "".join(piece(4) for _ in range(rng.randint(1, 6))) + "</body>"
        paths, nodes = text_nodes(page)

        def full(k):
            return (*full(paths.parent[k]), (paths.name[k], paths.mark[k], k)) if k else ()

        def chain(e):
            return (*chain(paths.up[e]), e) if e else ()
        want, length = twin_scores([(full(paths.of[e]), b, t) for e, b, t in nodes])
        scores, lengths, _ = path_scores(paths, nodes)
        for p in want:
            k = p[-1][2] if p else 0
            assert scores[k] == pytest.approx(want[p]) and lengths[k] == pytest.approx(length[p])
        if not any(want.values()):
            continue
        live = sorted((s, length[p]) for p, s in want.items() if s > 0)
        half, top = sum(n for _, n in live) / 2, 0
        for top, n in live:
            half -= n
            if half <= 0:
                break
        marks = [0.05 * top] + [s for s, _ in live if 0.05 * top < s < 0.5 * top] + [0.5 * top]
        gap = max(range(len(marks) - 1), key=lambda i: marks[i + 1] / marks[i])
        least = (marks[gap] * marks[gap + 1]) ** 0.5
        assert threshold(scores, lengths) == pytest.approx(least)
        chosen = {e for e, _, t in nodes if t.strip() and 0 < want[full(paths.of[e])] >= least}
        common = chain(min(chosen))
        for e in chosen:
            while chain(e)[:len(common)] != common:
                common = common[:-1]
        at = content_container(paths, chosen)
        expect = common
        for i, e in enumerate(common):
            if paths.element_name(e) in ("article", "main"):
                expect = common[:i + 1]
                break
            if paths.element_name(e) in ("a", "b", "span", "p", "ul", "li", "h2", "nav"):
                expect = common[:i]
                break
        assert at == (expect[-1] if expect else 0), page


def test_op10_is_linear_in_unclosed_tags():
    import time
    start = time.process_time()
    assert main_text("<b>x" * 100_000) == "x" * 100_000
    main_text("<p>" + "<b>x" * 50_000 + "<h1>y" * 50_000)
    main_text("<div class=ad>x, y." * 30_000)
    main_text("<section><p>" + "<b>x" * 50_000 + "<section>" + "<div>z" * 50_000 + "</b>" * 50_000)
    assert time.process_time() - start < 30


def test_op10_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")],
                               "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = extract_main_text(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


def brute_nearest(rows, mod, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % mod == 0:
            out[i] = [j for d, j in sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in ok if j != i)][:k]
    return out


def test_op3_recall_ties_and_bad_vectors(spark):
    from seqspark.llm.op03_nndescent import nearest
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]          # a hot vector
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (904, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("v", F.lit(1))
    want = brute_nearest(rows, 20, 10)
    got: dict = {}
    for r in nearest(df, query_mod=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, 11)) and [x[2] for x in found] == sorted(x[2] for x in found)
        hit += len({x[1] for x in found} & set(want[q]))
    assert hit >= 0.95 * 10 * len(want)
    assert [x[1] for x in got[400]] == [7, *range(401, 410)]    # ties: the smallest ids
    few = nearest(df.where("vec_id < 5"), query_mod=2).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(a, b) for a in (0, 2, 4) for b in range(5) if a != b}
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id = 1")).count() == 0


@pytest.mark.parametrize("scale", [1e-150, 1e-30, 1e22, 1e30, 1e150])
def test_op3_magnitude_does_not_matter(spark, scale):
    from seqspark.llm.op03_nndescent import nearest
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) * scale for x in rng.standard_normal(6)]) for i in range(150)]
    want = brute_nearest(rows, 50, 10)
    got: dict = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_mod=50, rounds=2).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert {q: len(v) for q, v in got.items()} == {0: 10, 50: 10, 100: 10}
    assert sum(len(got[q] & set(want[q])) for q in want) >= 28


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("- Exchange ")


def test_op3_orders_share_one_exchange(spark):
    from seqspark.llm.op03_nndescent import best_edges, first_graph, pack_vectors
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(300)]
    nodes = pack_vectors(spark.createDataFrame(rows, "node long, v array<double>"))
    graph = first_graph(nodes, 6, 300, orders=8, run=96, degree=24, seed=17)
    assert exchanges(graph) == 1                                # tasks do not multiply with the orders
    edges = best_edges(spark.createDataFrame(graph.collect(), graph.schema), 24)
    assert exchanges(edges) == 1
    rows = edges.collect()
    assert {r["u"] for r in rows} == set(range(300)) and max(np.bincount([r["u"] for r in rows])) <= 24


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    clean = " ".join(f"clean{i} words{i % 7}" for i in range(40))
    docs = [(8, "short text", "fr"), (None, "no id at all here", "en"), (None, "nor here", "en"), (0, clean, "en"), (1, clean, "en"), (2, clean + " tail", "en"), (3, None, "en"), (4, "12 34", "en"), (5, "", None),
            (6, f"some {bench} text", "en"), (7, " ".join(f"other{i}" for i in range(700)) + " " + bench, "fr"), (8, "short text", "fr")]
    full = [(d, t, x, "s", len(t or "")) for d, t, x in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, ids = table, []
    for name, stage in P.STAGES[:-1]:
        kept = P.save(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == table.columns
        ids.append(sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()))
    assert ids == [[-1, -1, 0, 1, 2, 6, 7, 8, 8], [-1, -1, 0, 6, 7, 8], [-1, -1, 0, 7, 8]]
    out = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {None, 0, 7, 8} and len(P.STAGES) == 4
