import numpy as np

from bulwark.llm import html_text as H
from bulwark.llm.html_text import LEAST, RUN, blocks_of, main_text, named_runs, repeated_elsewhere

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><p>site</p></header><nav><ul><li><a href="/x>y">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad banner">buy</div>
<article><h1>Head &amp; line</h1><p><b>One   two&nbsp;three.<br><p>Four
five</p><aside>side</aside><form><input><p>search</p></form><div class="newsletter-signup"><div>x</div>join</div><p hidden>no</p>
<ul><li>a</li><li>b &lt;c&gt;</li></ul><section id="comments"><p>nice</p><article class="comment"><p>me too</p></article></section></article>
<aside class="sidebar">s</aside><footer>&copy; f</footer></body></html>"""


def test_article_blocks():
    main, rest = blocks_of(PAGE)
    assert main == ["Head & line", "One two three.", "Four five", "a", "b <c>"]
    assert rest == []


def test_broken_markup():
    assert blocks_of("<article><p>x<p>y") == (["x", "y"], [])
    assert blocks_of("<script>never closed <p>z</p>") == ([], [])
    assert blocks_of("plain < text & more") == ([], ["plain < text & more"])
    assert blocks_of("") == ([], [])
    assert blocks_of("<main><p>a</main><p>b") == (["a"], ["b"])


def test_repeated_runs_go_where_structure_is_silent(spark):
    plate = "accept our terms and read about us before you go on with this site"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{plate}</div><div>{i} unique words follow here {i} only</div><div>{i} short</div></body>") for i in range(5)]
    rows += [(9, "http://other.example/9", f"<div>{plate}</div>"), (10, None, None), (11, "http://h.example/a", PAGE), (12, "http://h.example/b", PAGE), (3, "http://h.example/3", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {(r["page_id"], r["url"]): r["text"] for r in main_text(df).collect()}
    assert main_text(df).count() == len(rows)
    for i in range(5):
        assert got[i, f"http://h.example/{i}"] == f"{i} unique words follow here {i} only\n{i} short"
    assert got[9, "http://other.example/9"] == plate and got[10, None] == ""
    # one article on two pages of a host is not boilerplate
    assert got[11, "http://h.example/a"] == got[12, "http://h.example/b"] == "Head & line\nOne two three.\nFour five\na\nb <c>"
    assert main_text(df.limit(0)).count() == 0


def test_repeats_on_one_page_stay(spark):
    t = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, "http://h/1", f"<p>{t}</p><p>{t}</p>")] * 2, "page_id long, url string, html string")
    assert {r["text"] for r in main_text(df).collect()} == {f"{t}\n{t}"}


def test_runs_on_most_articles_of_a_host_go(spark):
    notice = "all prices are given without any warranty by the owner of this shop"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"http://h.example/{i}", f"<article><p>{body(i)}</p><p>{notice}</p></article>") for i in range(6)]
    rows += [(6, "http://h.example/6", f"<article><p>{body(0)}</p></article>"), (7, "http://h.example/7", f"<div>{body(7)}</div><div>{notice}</div>")]
    rows += [(8 + i, f"http://two.example/{i}", f"<main><p>{body(50)}</p><p>{notice}</p></main>") for i in range(4)]
    plate = "accept our terms and read about us before you go on with this site"
    rows += [(20 + i, f"http://c.example/{i}", f"<!-- <article> --><div>{plate}</div><div>{body(20 + i)}</div>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == body(i) for i in (*range(6), 7)) and got[6] == body(0)  # the notice goes, an article on two pages stays
    assert all(got[8 + i] == f"{body(50)}\n{notice}" for i in range(4))  # one text on all pages is no boilerplate
    assert all(got[20 + i] == body(20 + i) for i in range(3))  # <article> in a comment is no frame


def test_left_out_end_tags():
    assert blocks_of('<article><p>keep<ul><li class="related">x<li>y</ul><p>tail') == (["keep", "y", "tail"], [])
    assert blocks_of("<main><p>one<p hidden>two<p>three") == (["one", "three"], [])
    assert blocks_of('<article><section class="search results"><p>a</section></article>') == (["a"], [])
    assert blocks_of('<article><p>a<div class=ad>b</article><p>c') == (["a"], ["c"])
    assert blocks_of('<article>a<span class="ad">b<span>c</span>d</span>e</article>') == (["a", "e"], [])
    assert blocks_of("<div role=main><p>x</div><p>y") == (["x"], ["y"])
    assert blocks_of('<article><ul><li class="ad">a<ul><li>b</ul><li>c</ul>') == (["c"], [])


def test_suffix_array_finds_the_longest_repeats():
    rng = np.random.default_rng(0)
    for _ in range(100):
        least, texts = int(rng.integers(1, 5)), [rng.integers(0, 3, rng.integers(0, 25)).tolist() for _ in range(4)]
        tokens = np.array([t for k, x in enumerate(texts) for t in [*x, 100 + k]])
        page = np.array([p for k, x in enumerate(texts) for p in [k] * len(x) + [10 + k]])
        want = []
        for i in range(len(tokens)):
            best = 0
            for j in np.flatnonzero(page != page[i]):
                k = 0
                while max(i, j) + k < len(tokens) and tokens[i + k] == tokens[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best if best >= least else 0)
        assert repeated_elsewhere(tokens, page, least).tolist() == want


def site(rng, rows):
    """Pages of a few hosts: own words, passages that the host repeats on some of them, and copies."""
    word = lambda: f"w{rng.integers(0, 5000)}"
    shared = {h: [[word() for _ in range(rng.integers(5, 25))] for _ in range(4)] for h in range(5)}
    out = []
    for i in range(rows):
        h = int(rng.choice(5, p=[0.5, 0.3, 0.1, 0.05, 0.05]))
        parts = [[word() for _ in range(rng.integers(1, 60))] for _ in range(3)]
        parts += [p for k, p in enumerate(shared[h]) if rng.random() < (0.95, 0.6, 0.4, 0.05)[k]]
        order = rng.permutation(len(parts))
        out.append((i, f"http://h{h}.example/{i}", [" ".join(parts[k]) for k in order]))
        if rng.random() < 0.1:
            out.append((1000 + i, f"http://h{h}.example/{i}/copy", out[-1][2]))
    return out


def by_brute_force(pages):
    """The rule of main blocks, run by run."""
    runs, of_host = {}, {}
    for i, url, blocks in pages:
        w = " ".join(blocks).split()
        of_host.setdefault(url.split("/")[2], []).append(i)
        for k in range(len(w) - RUN + 1):
            runs.setdefault((url.split("/")[2], tuple(w[k : k + RUN])), {})[i] = "\n".join(blocks)
    plates = {k for k, at in runs.items() if 2 * len(at) > len(of_host[k[0]]) and len(set(at.values())) >= LEAST}
    out = {}
    for i, url, blocks in pages:
        w = " ".join(blocks).split()
        gone = {k + j for k in range(len(w) - RUN + 1) if (url.split("/")[2], tuple(w[k : k + RUN])) in plates for j in range(RUN)}
        left = H.unique_runs([b.split() for b in blocks], gone)
        out[i] = left or "\n".join(blocks)
    return out


def test_two_hundred_pages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 3000)
    pages = site(np.random.default_rng(1), 200)
    want = by_brute_force(pages)
    assert 50 < sum(want[i] != "\n".join(b) for i, _, b in pages)
    rows = [(i, u, "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in b) + "</article>") for i, u, b in pages]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, hosted string").repartition(3)
    assert {r["page_id"]: r["text"] for r in main_text(df).collect()} == want


def test_named_runs_of_one_part():
    h = np.arange(40, dtype=np.uint64) % np.uint64(20)  # two rows of the same twenty words
    row, hosts = np.repeat([0, 1], 20), np.array([5, 5])
    assert len(named_runs(h, row, hosts)[0]) == 13
    assert len(named_runs(h, row, np.array([5, 6]))[0]) == 26  # one row a host: any run is on more than half
    assert len(named_runs(h[:0], row[:0], np.array([5]))[0]) == 0


def test_very_long_page(spark):
    body = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, "http://h/1", f"<article><p>{body}</p></article>"), (2, "http://h/2", "<article>short</article>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(df).collect()} == {1: body, 2: "short"}
