"""Main-text extraction: the run against brute force, what its weights decide, and pages that are badly nested."""

import re
import time
from collections import Counter

import numpy as np
from compare import database

from tallyforge.llm import html_extract


def learned(pages, *, lists=True):
    counts: dict[str, Counter] = {}
    for page in pages:
        for feature, where in html_extract.element_counts(html_extract.Page(page), lists=lists):
            counts.setdefault(feature, Counter())[where] += 1
    return html_extract.scores_of(counts, lists=lists)


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 12))
        words, costs = rng.integers(0, 6, n).tolist(), rng.integers(0, 5, n).astype(float).tolist()
        first, last = html_extract.best_run(words, costs)
        # a run's own first cost lies before it
        total = lambda i, j: sum(words[i : j + 1]) - sum(costs[i + 1 : j + 1])
        best = max((total(i, j) for i in range(n) for j in range(i, n)), default=0)
        assert (total(first, last) if last >= first else 0) == best


def test_learned_weights_decide_the_text():
    words = "plain running words of the story that go on and on for a while"
    article = lambda x: f"<body><div class=qq>offers of the day and more</div>{x[0]}<h1>Title</h1><p>{words}</p><p>End.</p>{x[1]}<section id=zz>{words}</section></body>"
    scores = learned([article(("<article>", "</article>"))] * 20)
    plain = article(("<div>", "</div>"))
    assert html_extract.extract(plain, scores) == f"Title\n\n{words}\n\nEnd."
    unlearned = html_extract.extract(plain, learned([]))
    assert "offers" in unlearned and unlearned.endswith(words)
    # of another weight, another text: what was learned is all that tells these elements apart
    other = scores | {".qq": (0.0, 0.0), ".zz": (0.0, 0.0)}
    assert html_extract.extract(plain, other) == unlearned
    costly = scores | {"p": (0.5, 0.0)}
    assert html_extract.extract(plain, costly) != html_extract.extract(plain, scores)
    assert html_extract.extract(article(("<article>", "</article>")), learned([])) == f"Title\n\n{words}\n\nEnd."


def test_the_method_alone_finds_articles_whose_element_is_taken_away():
    pages = [p for (p,) in database("/root/testdata/sf0.1").execute("select html from pages order by page_id limit 1000").fetchall()]
    scores = learned(pages[500:], lists=False)
    named = learned(pages[500:])
    same = 0
    for page in pages[:500]:
        bare = re.sub(r"</?article>", "", page)
        same += html_extract.extract(bare, scores) == html_extract.extract(page, named)
    assert same == 500


def test_badly_nested_pages_take_linear_time():
    n = 20_000
    for page in ("<div>x" * n, "<a " * n, '<a x">" ' * n, "<title>x" * n, "<div>" * n + "</span>x" * n, "<!--" * n, "<a '\">" * n, "<nav>" + "<article>y" * n + "</nav>", "<b>x</i>" * n, "<svg>x" * n, "<" * n):
        began = time.perf_counter()
        html_extract.extract(page, learned([]))
        once = time.perf_counter() - began
        assert once < 2, page[:20]
    assert len(html_extract.extract("<div>x" * n, learned([])).split()) == n


def test_the_sample_of_labelled_pages_is_determined(spark):
    page = "<body><div class=c{}>outside words</div><article><p>words of it</p></article></body>"
    rows = [(i, "u", page.format(i % 3)) for i in range(400)]
    one = html_extract.tag_scores(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), train_pages=100)
    two = html_extract.tag_scores(spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(2), train_pages=100)
    assert one == two and one[".c1"][0] > 0.9


def test_extraction_with_clashing_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a &lt; b", "t", 5), (1, "u", "<p>a &lt; b", "t", 5), (None, None, "<article>x</article>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    rows = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract_main_text(pages).collect())
    assert rows == [(0, "x", 1), (1, "a < b", 5), (1, "a < b", 5)]


def test_titles_notices_and_comments(spark):
    words = "plain running words of the story that go on and on for a while"
    page = f"""<body><div>We use cookies on this site so that you have a better time here with all of our many pages today and tomorrow</div>
    <article><header><h1>Short</h1></header><div class="ad">Buy</div><p>{words}</p><form><p>Sign up for more words than the story has {words}</p></form><div class=gallery><p>One.</p></div>
    <article class="comment"><p>{words} {words}</p></article><p>Fin.</p><footer>By me</footer></article><div id="disqus"><p>{words * 9}</p></div></body>"""
    assert html_extract.extract(page, learned([])) == f"Short\n\n{words}\n\nOne.\n\nFin."
    teasers = f"<main><article><p>{words}</p></article><article><p>{words} again</p></article></main><footer>x</footer>"
    assert html_extract.extract(teasers, learned([])) == f"{words}\n\n{words} again"


def test_junk_goes_however_much_of_the_page_it_is():
    junk = " ".join(f"junk{i}" for i in range(33))
    short = "one two three four five six seven eight nine ten"
    for page in (f'<article><p>{short}</p><div class="ad">{junk}</div></article>', f"<article><p>{short}</p><form><p>{junk}</p></form></article>", f'<body><div class="sidebar"><p>{junk}</p></div><p>{short}</p></body>'):
        assert html_extract.extract(page, learned([])) == short
    whole = f"<body><form><nav>{junk}</nav><article><p>{short}</p></article></form></body>"
    assert html_extract.extract(whole, learned([])) == short, "a form around the content is no form of it"
    assert html_extract.extract(f"<body><form><p>{short}</p></form></body>", learned([])) == short


def test_the_run_alone_finds_the_text():
    """Article tags taken away, lists off, no element dropped: what the run leaves at both ends is all that parts text from menus."""
    pages = [p for (p,) in database("/root/testdata/sf0.1").execute("select html from pages order by page_id limit 1000").fetchall()]
    scores, named = learned(pages[500:], lists=False), learned(pages[500:])
    bare = [re.sub(r"</?article>", "", page) for page in pages[:500]]
    texts = [html_extract.extract(page, named) for page in pages[:500]]
    alone = sum(html_extract.extract(b, scores, drop=False) == t for b, t in zip(bare, texts, strict=True))
    neither = sum(html_extract.extract(b, scores, drop=False, run=False) == t for b, t in zip(bare, texts, strict=True))
    assert alone >= 450 and neither < 50, (alone, neither)


def test_without_the_run_other_text_comes_in():
    words = "plain running words of the story that go on and on for a while"
    page = f"<body><div>Use of this site means that you agree</div><div><nav>{words}</nav></div><div><h1>Title</h1><p>{words}</p><p>{words}</p></div><footer>{words}</footer><div>All rights</div></body>"
    text = html_extract.extract(page, learned([]))
    assert text == f"Title\n\n{words}\n\n{words}" != html_extract.extract(page, learned([]), run=False)
