"""Main text of pages: typed mark-up, hosts without mark-up, copies, and the suffix array against plain counting."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from bazaarlens.llm import boilerplate, markup
from bazaarlens.session import cut_lineage, shared_dir

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def texts(spark, rows):
    got = boilerplate.main_text(spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    return got


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), ("  plain \n words &amp; more", [(1, "plain words & more")]),
    ("<title>t</title><nav>menu</nav><article><h1>T &lt;x&gt;</h1><p>one<p><b>two<br>2</article><footer>f",
     [(0, "menu"), (2, "T <x>"), (2, "one"), (2, "two 2"), (0, "f")]),
    ("<article><p>a</p><aside>s</aside><div class='ad-slot'>buy</div><form>q <input> <button>go</button></form><p>b<i cut='off",
     [(2, "a"), (0, "s"), (0, "buy"), (0, "q go"), (2, "b")]),
    ("<main><h1>T</h1><article><p>x</article><section id=comments><article class=comment>no</article></section></main>",
     [(2, "T"), (2, "x"), (0, "no")]),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no --><main>yes<script>if (a<b) x()</script></main>",
     [(2, "yes")]),
    ("<div class=cookie-notice>we <div><article><p>unclosed notice</article>", [(0, "we"), (2, "unclosed notice")]),
    ("<body class='has-sidebar no-comments'><div role=main><p>in</p></div><div role=navigation>out</div>", [(2, "in"), (0, "out")]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>",
     [(1, x) for x in "a b c d 1 2 3".split()]),
    ("<p>a <span class=ad>buy</span> b <a href='x>y'>l</a></p>", [(1, "a"), (0, "buy"), (1, "b l")]),
    ("<article><header><h1>T</h1></header><p>x</p><footer>tags</footer></article><header>site</header>",
     [(2, "T"), (2, "x"), (0, "tags"), (0, "site")]),
    ("<p>1 < 2 &nbsp; &#233;&#x41;&copy &unknown;", [(1, "1 < 2 éA© &unknown;")]),
    ("<div hidden>no</div><div style='display: none'>no</div><p>yes", [(0, "no"), (0, "no"), (1, "yes")]),
])
def test_blocks(html, want):
    assert [(b.state, b.text) for b in markup.blocks(html)] == want


def test_hostile_markup_stays_linear():
    for s in ("<div>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<p title=\"" * 50_000, "</p>" * 200_000, "<a b='" * 50_000,
              "<li>" * 100_000 + "x", "<" * 300_000, "&" * 300_000):
        markup.blocks(s)


def sentence(r, n):
    return " ".join(r.choice("abcdefghij") + str(r.randrange(1000)) for _ in range(n))


def host(r, name, n, head, tail, notice=""):
    for i in range(n):
        own = [sentence(r, 40) for _ in range(3)]
        body = "".join(f"<div>{p}</div>{notice if k == 1 else ''}" for k, p in enumerate(own))
        yield f"https://{name}/p{i}", f"<div>{head}</div>{body}<div>{tail}</div>", "\n\n".join(own)


def test_repeated_parts_of_a_host_go(spark):
    r = random.Random(3)
    head, tail, notice = sentence(r, 12), sentence(r, 25), "<div>" + sentence(r, 9) + "</div>"
    rows = [*host(r, "a.example", 20, head, tail, notice), *host(r, "b.example", 4, sentence(r, 8), tail)]
    # the same page of another host has no partner there, so all of it stays
    rows.append(("http://c.example/", f"<div>{head}</div><div>own</div>", f"{head}\n\nown"))
    want = {i: t for i, (_, _, t) in enumerate(rows)}
    got = texts(spark, [(i, u, h) for i, (u, h, _) in enumerate(rows)])
    assert {x["page_id"]: x["text"] for x in got} == want
    assert {x["page_id"]: x["n_repeated"] for x in got}[0] == 12 + 25 + 9


def test_copies_keep_their_text(spark):
    """Pages that are copies of one another, exact or near, share their text; shared passages of articles stay too."""
    r = random.Random(4)
    one = [sentence(r, 60) for _ in range(4)]
    page = lambda ps: "".join(f"<div>{p}</div>" for p in ps)
    rows = [(i, "http://a.example/x", page(one)) for i in range(6)]
    near = [[*one[:k], one[k] + f" edit{k}", *one[k + 1:]] for k in range(4)]
    rows += [(10 + k, "http://a.example/y", page(n)) for k, n in enumerate(near)]
    shared = sentence(r, 60)
    articles = [f"<article><p>{sentence(r, 30)}</p><p>{shared}</p></article>" for _ in range(8)]
    rows += [(20 + k, "http://q.example/", a) for k, a in enumerate(articles)]
    got = {x["page_id"]: x["text"] for x in texts(spark, rows)}
    assert all(got[i] == "\n\n".join(one) for i in range(6))
    assert all(got[10 + k] == "\n\n".join(n) for k, n in enumerate(near))
    assert all(got[20 + k].endswith("\n\n" + shared) for k in range(8))


def test_articles_are_in_the_suffix_array(spark):
    """A passage of many articles is found and stays; outside an article, the same words are not boilerplate for it."""
    r = random.Random(6)
    shared, menu = sentence(r, 20), sentence(r, 10)
    rows = [(i, "http://a.example/", f"<nav>{menu}</nav><article><p>{sentence(r, 30)}</p><p>{shared}</p></article>") for i in range(5)]
    rows.append((9, "http://a.example/", f"<div>{shared}</div><div>{sentence(r, 30)}</div>"))
    got = {x["page_id"]: x for x in texts(spark, rows)}
    assert all(got[i]["text"].endswith("\n\n" + shared) and got[i]["n_repeated"] == 30 for i in range(5))
    assert got[9]["text"].startswith(shared) and got[9]["n_repeated"] == 0


def test_windows_against_plain_counting(spark):
    r = random.Random(5)
    parts = [sentence(r, 8) for _ in range(6)]
    rows = []
    for i in range(60):
        ps = [r.choice(parts) if r.random() < 0.5 else sentence(r, r.choice([3, 10, 30])) for _ in range(r.randrange(1, 6))]
        rows.append((i, r.choice(["http://a.example/", "http://b.example/", None]), "".join(f"<p>{p}</p>" for p in ps)))
    rows += rows[:4]
    parsed = cut_lineage(boilerplate._parsed(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)))
    found = {bytes(x["stream"]): {bytes(y["words"]): y["common"] for y in x["found"]}
             for x in boilerplate.boilerplate(parsed).collect()}
    streams = {}
    for x in parsed.collect():
        own, _, _ = boilerplate.windows([y["text"] for y in x["rest"]])
        streams[bytes(x["stream"])] = (bytes(x["host"]), {w.tobytes() for w in own}, bool(x["kept"]))
    holders, sizes = defaultdict(set), Counter(h for h, _, _ in streams.values())
    for s, (h, ws, _) in streams.items():
        for w in ws:
            holders[h, w].add(s)
    repeated = {k: v for k, v in holders.items() if len(v) >= boilerplate.PAGES}
    own = {s for s, (h, ws, d) in streams.items()
           if d or sum((h, w) not in repeated for w in ws) >= boilerplate.OWN * len(ws)}
    want = defaultdict(dict)
    for (h, w), v in repeated.items():
        if len(v & own) >= boilerplate.PAGES and 2 * len(v & own) >= len(v):
            for s in v:
                want[s][w] = len(v) >= boilerplate.HOST_SHARE * sizes[h]
    assert found == want and any(want.values())


def test_edges(spark):
    long = "<article><p>" + "word &amp; " * 200_000 + "</p></article>"
    rows = [(1, None, None), (None, "http://a/", "<p>x</p>"), (3, "no host", "<nav>only a menu</nav>"), (4, "", ""),
            (5, "http://a/", long), (5, "http://a/", long), (6, "http://é.example/", "<p>퟿\U0001F600</p>")]
    got = texts(spark, rows)
    by = defaultdict(list)
    for x in got:
        by[x["page_id"]].append(x["text"])
    assert by[1] == [""] and by[None] == ["x"] and by[3] == [""] and by[4] == [""] and by[6] == ["퟿\U0001F600"]
    assert by[5] == [("word & " * 200_000).strip()] * 2
    empty = boilerplate.main_text(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["page_id", "url", "text", "n_chars", "n_repeated"] and empty.count() == 0


def unlike_pages(r, n, words):
    return [(i, "http://a.example/", f"<article><p>{sentence(r, words)}</p></article>") for i in range(n)]


def on_disk(spark):
    """Bytes of all files in the shared folder and of all shuffle files."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shared = Path(shared_dir(spark).removeprefix("file:"))
    return (sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
            + sum(p.stat().st_size for d in blocks for p in Path(d).rglob("shuffle_*.data") if p.is_file()))


def test_disk_stays_below_the_text(spark):
    """Words that do not repeat are kept once, compressed, and their windows travel as differences of short keys."""
    rows = unlike_pages(random.Random(7), 1000, 400)
    before = on_disk(spark)
    assert all(x["n_repeated"] == 0 for x in texts(spark, rows))
    assert on_disk(spark) - before < 1.2 * sum(len(h) for _, _, h in rows)


def test_packs_and_ranges_change_nothing(spark, monkeypatch):
    """Copies, articles and open blocks over many packs and key ranges, with a first round that tells nothing apart."""
    r = random.Random(8)
    parts = [sentence(r, r.choice([6, 8, 20])) for _ in range(8)]
    rows = []
    for i in range(200):
        ps = [r.choice(parts) if r.random() < 0.5 else sentence(r, r.choice([2, 9, 30])) for _ in range(r.randrange(7))]
        body = "".join(r.choice(["<div>{}</div>", "<nav>{}</nav>", "<li><a href=x>{}</a></li>"]).format(p) for p in ps)
        body += f"<article>{r.choice(parts)} {sentence(r, 9)}</article>" if i % 3 == 0 else ""
        rows.append((i, r.choice(["http://a.example/", "http://b.example/", None]), body))
    rows += [(1000 + i, *r.choice(rows)[1:]) for i in range(100)] + rows[:5]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)
    one = boilerplate.main_text(df.coalesce(1)).collect()
    monkeypatch.setattr(boilerplate, "TABLE_ROWS", 300)
    monkeypatch.setattr(boilerplate, "SPARE_BITS", -8)
    many = boilerplate.main_text(df.repartition(9)).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, many)) and any(x["n_repeated"] for x in one)
