from spindle.llm import html_text as ht

MODEL = ht.trained()


def brute_marginals(page, model):
    """By summing over all labellings."""
    import itertools

    import numpy as np

    z = ht.node_features(page) @ model.weights
    n = len(page.parent)
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(z[i] * y[i] for i in range(n)) + sum(model.pairs[y[page.parent[i]], y[i]] for i in range(1, n)))
        total += w
        on += w * np.array(y)
    return on / total


def test_messages_give_the_exact_marginals():
    import numpy as np

    for source in ("<article><h1>T</h1><p>Some text.</p><div class=ad><p>Buy</p></div></article>", "<nav><ul><li><a href=x>a</a></ul></nav><p>one two", "text <form><button>go</button></form>"):
        page = ht.Page(source)
        assert np.allclose(MODEL.marginals(page), brute_marginals(page, MODEL))


def test_expectations_of_many_trees_equal_those_of_each():
    """Training sums over whole trees: marginals, label pairs and the partition function, against all labellings."""
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    parents = [[-1, 0, 0, 1, 1, 3], [-1], [-1, 0, 1, 2]]
    trees, pairs = ht._Trees(parents), r.normal(size=(2, 2))
    zs = [r.normal(size=len(p)) for p in parents]
    p, counts, whole = trees.expected(np.concatenate(zs), pairs)
    at, total, log_z = 0, np.zeros((2, 2)), 0.0
    for parent, z in zip(parents, zs):
        weight, on, pair = 0.0, np.zeros(len(z)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(z)):
            w = np.exp(sum(a * b for a, b in zip(z, y)) + sum(pairs[y[parent[i]], y[i]] for i in range(1, len(z))))
            weight += w
            on += w * np.array(y)
            for i in range(1, len(z)):
                pair[y[parent[i]], y[i]] += w
        assert np.allclose(p[at : at + len(z)], on / weight)
        at += len(z)
        total += pair / weight
        log_z += np.log(weight)
    assert np.allclose(counts, total) and np.isclose(whole, log_z)


def test_held_out_accuracy():
    wrong = total = 0
    for source in ht.labelled_pages(120, seed=77):
        page = ht.Page(source)
        y = ht.labels_of(page)
        keep = MODEL.marginals(page) >= 0.5
        total += len(page.parts)
        wrong += sum(bool(y[k]) != keep[k] for k, _ in page.parts)
    assert total > 1000 and wrong < 0.04 * total


P = "<p>The river rose in the night, and by morning the lower fields were under water.</p>"
#: Pages that nobody's generator made: layouts of blogs, news, documentation, shops and encyclopaedias, with what is to stay.
LAYOUTS = [
    (f'<body class="home blog"><div id="page"><div id="masthead"><p><a href="/">My blog</a></p></div><ul class="menu"><li><a href="/a">About</a></ul><div id="primary"><div id="post-12" class="post type-post hentry"><h2>Flood</h2><div class="entry-content">{P}{P}</div></div></div><div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></div></div></body>', 3),
    (f'<header class="site-header"><nav><a href="/">News</a><a href="/w">World</a></nav></header><main><article class="story"><h1>Flood in the valley</h1>{P * 4}<aside class="related"><h3>More</h3><ul><li><a href="/q">Other story</a></ul></aside>{P}</article><section class="comments"><h2>Comments</h2><div class="comment"><p>Terrible news, I hope that everyone is safe there.</p></div></section></main><footer><p>Copyright</p></footer>', 6),
    (f'<div class="sidebar"><ul><li><a href="/i">Install</a></li><li><a href="/u">Use</a></li></ul></div><div class="content"><h1>Use</h1>{P}<pre>run --fast</pre>{P}<ul><li>First, open it.</li><li>Then, close it.</li></ul><table><tr><td>flag</td><td>meaning of it</td></tr></table></div>', 8),
    (f'<div id="cookie-consent"><p>We use cookies to improve this site.</p><button>Accept</button></div><div class="wrapper"><div class="article-body"><h1>Boots</h1><p>A short one.</p>{P}<blockquote>{P}</blockquote></div><div class="newsletter"><form><label>Mail</label><input><button>Subscribe</button></form></div></div>', 4),
    (f'<div id="content"><h1 id="firstHeading">River</h1><div id="bodyContent">{P}<h2>Course</h2>{P * 2}<h2>See also</h2></div></div><div id="footer"><ul><li><a href="/p">Privacy</a></li></ul></div>', 6),
]


def test_layouts_that_training_did_not_make():
    for source, lines in LAYOUTS:
        text = ht.extract(source, MODEL).split("\n")
        assert len(text) == lines, text
        assert text.count("The river rose in the night, and by morning the lower fields were under water.") == source.count(P)


def test_articles_are_not_lost():
    many = "<p>One two three four five six seven eight nine ten eleven twelve.</p>" * 8
    assert ht.extract("<article><p>First part of the text that is long enough to read.</p><p>Second <a>link text here is all there is</a></p></article>", MODEL).count("\n") == 1
    assert ht.extract(f'<article><h1>Title</h1><div class="more-info">{many}</div></article>', MODEL).count("\n") == 8
    assert ht.extract(f'<article><h1>Title</h1><p>Intro text is here.</p><section class="related-work"><h2>Related work</h2>{many}</section></article>', MODEL).count("\n") == 10
    assert ht.extract("<article><p><a href=x>only a link</a></p></article>", MODEL) == "only a link"
    assert ht.extract("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> here, done.</p></article>", MODEL) == "We have x=1 here, done."
    assert ht.extract("<html><head><title>t</title><article><p>Some text of it.</p></article>", MODEL) == "Some text of it."
    assert ht.extract("<nav><a href=x>menu</a></nav><div class=ad>Buy</div>", MODEL) == ""


def test_deep_nesting_takes_linear_time():
    import time

    start = time.process_time()
    for source in ("<div>" * 100_000, "<ul><li>" * 50_000, "<b>" * 100_000 + "</p>" * 1000, "<table><tr><td>" * 30_000 + "</table>" * 30_000):
        ht.Page(source)
    assert time.process_time() - start < 12
    text = ht.extract("<article>" + "<div>" * 3000 + "<p>deep down, a text.</p>", MODEL)
    assert text in ("deep down, a text.", "")


CASES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>", ""), ("<p>a  b\n c&nbsp;d<p>e", "a b c d\ne"), ("<article><p>x &lt;b&gt; &#233; &amp &unknown; &am", "x <b> é & &unknown; &am"),
    ("<article><p>One two three.</p><script>if (a<b) {'</p>'}</script><style>p{}</style><p>Four</p></article>", "One two three.\nFour"),
    ('<body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>Title</h1><p><b>Bold start.<br><p>Next one.</p></article><footer>&copy; me</footer></body>', "Title\nBold start.\nNext one."),
    ('<div class="cookie-notice">We use cookies <button>OK</button></div><div id="content"><p>Hello there, world.</p></div><div class="comments"><p>Nice post, thanks for this.</p></div>', "Hello there, world."),
    ("<main><h1>T</h1><form><input><button>Go</button></form><p>abc def.</p><aside><p>related stuff</p></aside></main>", "T\nabc def."),
    ('<header><a href="/">Site</a></header><main><p>Main text is here.</p></main><div class="sidebar"><p>Popular posts</p></div><div class="ad">Buy this now</div>', "Main text is here."),
    ("<article><p>cut off in a tag</p><p clas", "cut off in a tag"), ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"), ("<article><!-- <p>no</p> --><p>yes it is</p></article>", "yes it is"),
]


def test_cases():
    for source, text in CASES:
        assert ht.extract(source, MODEL) == text, source


def test_query(spark):
    rows = [(i, "u", s, 1) for i, (s, _) in enumerate(CASES)] + [(None, None, "<p>" + "long text here. " * 20_000, 1), (0, "u", "<p>twice</p>", 1), (0, "u", "<p>twice</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = ht.digest(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(r["text"] for r in got if r["page_id"] == 0) == ["", "twice", "twice"]
    assert ht.digest(df.limit(0)).count() == 0
