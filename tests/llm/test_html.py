import html
import re

import numpy as np

from millrace.llm import htmltext
from millrace.llm.common import table

PAGES = "page_id long, url string, html string"


def main(page):
    return [t for role, t in htmltext.parse(page) if role != htmltext.OUTSIDE]


def test_structure():
    page = '<html><head><title>x</title></head><body><nav><ul><li>a b</ul></nav><div class=ad>buy</div><article><header><h1>T &amp; U</h1><p>by x</p></header><p><b>One<br>two <i>th</i>ree<p>Four &#233;&eacute;&copy 5</p><div class="comments"><p>hey</div><table><tr><td>a<td>b<tr><td>c</table><form>z</form></article><footer>f</footer>'
    assert main(page) == ["T & U", "One two three", "Four éé© 5", "a b", "c"]
    assert main('<p>a<p class="ad">bad<p>c') == ["a", "c"]
    assert main("<div><main>m1 <p>m2</main> after</div>") == ["m1", "m2"]
    assert main('<p>x</p><script>if (a<b) "</p>"</script>y<!-- z') == ["x", "y"]
    assert main('<article>a</article><article class="comment">b</article>') == ["a"]
    assert main('<article><p>t</p><aside>s</aside><div id="cookie-notice">n</div><section class="userComments">c</section></article>') == ["t"]
    assert main("1 < 2 & 3 <4") == ["1 < 2 & 3 <4"] and main("") == [] and main("<p>\n \t</p>") == []
    assert main("<P>A\n\n b</P>") == ["A b"]


def test_articles_of_the_table(spark, sf):
    rows = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = htmltext.main_text(table(spark, sf, "pages")).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_host_repeats_go(spark):
    boiler = "all rights are reserved by the owners of this site and their heirs"
    rows = [(i, f"http://h.org/{i}", f"<p>{boiler}</p><p>story number {i} has its own words w{i} x{i} y{i} z{i}</p><div>start{i} {boiler} end{i}</div>") for i in range(1, 6)]
    rows += [(9, "http://other.org/", f"<p>{boiler}</p>"), (10, None, None), (11, "http://h.org/1", "<article>" + boiler + " kept tail</article>"), (None, "bad[", "<p>t</p>")]
    rows += [(20, "http://c.org/a", "<p>copies of a page are no evidence of boilerplate at all</p>")] * 2 + [(21, "http://c.org/b", "<p>copies of a page are no evidence of boilerplate at all</p>")]
    got = htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by[3] == "story number 3 has its own words w3 x3 y3 z3\n\nstart3 end3"
    assert by[9] == boiler and by[10] == "" and by[None] == "t"
    assert by[11] == "kept tail"
    assert by[20] == by[21] == "copies of a page are no evidence of boilerplate at all"
    assert htmltext.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_recaptures_are_no_evidence(spark):
    text = "the council met on monday evening to vote about the new bridge and after a long debate the plan was passed with nine votes against four"
    page = f"<p>{text}</p><p>work on the river bank starts next spring and the road will be closed for about two years from then on</p>"
    rows = [(i, f"http://r.org/{i}", f"<p>seen {i} times</p>{page}") for i in range(6)]
    rows += [(10 + i, "http://u.org/one", f"<p>{text} {' '.join(f'a{i}x{k}' for k in range(30))}</p>") for i in range(4)]
    by = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(6):
        assert by[i] == "\n\n".join(main(rows[i][2])) and text in by[i]
    assert all(text in by[10 + i] for i in range(4))


def test_teasers_take_nothing_from_articles(spark):
    head = "council votes for the new bridge across the river after a debate of nine long hours"
    rows = [(0, "http://t.org/0", f"<article><h1>{head}</h1><p>story</p></article>")]
    rows += [(i, f"http://t.org/{i}", f"<aside><a>{head}</a></aside><article>other story {i}</article>") for i in range(1, 5)]
    rows += [(i, f"http://t.org/{i}", f"<aside><a>{head}</a></aside><p>{' '.join(f'b{i}x{k}' for k in range(20))}</p>") for i in range(5, 9)]
    by = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert by[0] == f"{head}\n\nstory" and by[6].startswith("b6x0 ")


def test_two_pages_or_a_short_run_are_no_evidence(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    short = " ".join(line.split()[:9])
    own = lambda i: " ".join(f"c{i}x{k}" for k in range(30))
    rows = [(i, f"http://two.org/{i}", f"<p>{own(i)}</p><p>{line}</p>") for i in range(2)]
    rows += [(i, f"http://three.org/{i}", f"<p>{own(i)}</p><p>{line}</p><p>{own(i)}</p><p>{short}</p>") for i in range(2, 5)]
    by = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(by[i] == f"{own(i)}\n\n{line}" for i in range(2))
    assert all(by[i] == f"{own(i)}\n\n{own(i)}\n\n{short}" for i in range(2, 5))


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 2, rng.integers(0, 40)))) for _ in range(30)]
    tokens, owner = htmltext._tokens(texts)
    order, rank = htmltext.suffix_classes(tokens, owner)
    flat = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    d = htmltext.DEPTH
    windows = {i: tuple(w for _, w in flat[i : i + d]) for i in range(len(flat) - d + 1) if flat[i][0] == flat[i + d - 1][0]}
    assert set(order.tolist()) == set(windows)
    groups = {}
    for i, r in zip(order.tolist(), rank.tolist(), strict=True):
        groups.setdefault(r, set()).add(windows[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(windows.values()))
    assert len({int(h) for h in htmltext._classes(tokens)[order]}) == len(groups)


def covered_by_plain_code(pages):
    """Tokens of undecided blocks that no substring of DEPTH tokens covers which PAGES pages show; pages differ in everything else."""
    blocks = {i: [t.split() for t in main(h)] for i, h in pages}
    d, shown = htmltext.DEPTH, {}
    flat = {i: [w for b in own for w in b] for i, own in blocks.items()}
    for i, w in flat.items():
        for k in range(len(w) - d + 1):
            shown.setdefault(tuple(w[k : k + d]), set()).add(i)
    gone = {}
    for i, w in flat.items():
        gone[i] = {k + o for k in range(len(w) - d + 1) if len(shown[tuple(w[k : k + d])]) >= htmltext.PAGES for o in range(d)}
    return {i: [w for k, w in enumerate(flat[i]) if k not in gone[i]] for i in flat}


def test_repeats_against_plain_code(spark):
    rng = np.random.default_rng(12)
    common = [" ".join(f"c{j}x{k}" for k in range(n)) for j, n in enumerate((9, 11, 12, 13, 40))]
    pages = []
    for i in range(12):
        paragraphs = [" ".join(f"p{i}x{j}x{k}" for k in range(rng.integers(25, 60))) for j in range(4)]
        paragraphs += [common[j] for j in range(5) if rng.random() < 0.4]
        rng.shuffle(paragraphs)
        pages.append((i, "".join(f"<p>{t}</p>" for t in paragraphs)))
    df = spark.createDataFrame([(i, f"http://p.org/{i}", h) for i, h in pages], PAGES)
    got = {r.page_id: r.text.split() for r in htmltext.main_text(df).collect()}
    assert got == covered_by_plain_code(pages)


def test_long_pages_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, "http://l.org/1", f"<p>{long}</p>"), (2, "http://l.org/2", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, None, "<" * 100_000), (4, "http://l.org/4", "a" * 500_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS page", "'x' AS text", "3 AS node", "4 AS main", "5 AS roles", "6 AS component", "7 AS class")
    got = {r.page_id: r for r in htmltext.main_text(df).collect()}
    assert got[1].text == long and got[2].text == "deep" and got[4].n_chars == 500_000 and len(got) == 4
    assert set(got[1].asDict()) == {"page_id", "url", "text", "n_chars"}
