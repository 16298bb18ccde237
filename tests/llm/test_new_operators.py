"""Filter audit, page text and vector codes against brute force on small fixtures."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest

from trackweave.llm import filter_audit, page_text, vector_codes
from trackweave.llm.queries import ORACLE, QUERIES
from trackweave.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ---------------------------------------------------------------------


def audit(docs, labels):
    rows = cut_lineage(filter_audit.described(docs, docs["lang"]))
    return filter_audit.orders(filter_audit.survivors(filter_audit.failed(rows, labels)))


def slow_audit(docs, labels):
    """Every order applied to every document, one after the other."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    ids = {}
    for d, text, _ in docs:
        if d is not None:
            ids.setdefault(text or "", set()).add(d)
    facts = []
    for d, text, lang in docs:
        text = text or ""
        found = WORD.findall(text)
        fails = {
            "A": len(found) < 200,
            "B": 100 * len(set(found)) < 50 * len(found),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and min(ids[text]) < d,
        }
        facts.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        of = [f for f in facts if f[0] == part]
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            left = of
            for step, own in enumerate(order, 1):
                hit = [f for f in left if own in f[1]]
                kept = [f for f in left if own not in f[1]]
                removed[own] = removed.get(own, 0) + len(hit)
                out[part, order, step] = [
                    len(kept),
                    len(hit),
                    sum(own in f[1] for f in of) - len(hit),
                    sum(f[1] == {own} for f in of),
                    sum(f[2] for f in hit),
                    sum(f[3] for f in hit),
                ]
                left = kept
        for part_, order, step in list(out):
            if part_ == part:
                out[part, order, step].append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def report(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_is_that_of_all_orders(spark):
    long = " ".join(f"word{i}" for i in range(220))
    docs = [
        (1, long, "en"),
        (2, long, "en"),
        (2, long, "en"),
        (3, long, "de"),
        (4, "a " * 300, "en"),
        (5, None, None),
        (6, "", ""),
        (7, "ONE # two", "de"),
        (8, long.upper(), "en"),
        (9, long + " |", "en"),
        (None, long, "en"),
        (None, "x", None),
        (10, "ü " * 120 + long, "xx"),
        (11, "Z" + "é" * 40, "xx"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (7, 1, 1), (99, 1, 1), (None, 1, 1), (9, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS fails", "2 AS part", "3 AS good", "4 AS digest")
    got = report(audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = slow_audit(docs, labels)
    assert len(got) == 120 * 5 * len({k[0] for k in want})
    assert got == want


def test_audit_of_nothing_and_of_odd_rows(spark, empty, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(empty, labels).count() == 0
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.select("doc_id", "text", "lang").collect()]
    assert report(audit(odd, labels)) == slow_audit(docs, [])


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i % 90}" for i in range(400)).encode()
    want = filter_audit.failures(text)
    monkeypatch.setattr(filter_audit, "LONG", 50)
    assert filter_audit.failures(text) == want
    assert sum(len(lot) for lot in filter_audit._lots(text)) == 400


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1001])
def test_positional_counts(n):
    some = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    want = [(int(((some >> np.uint32(b)) & 1).sum())) for b in range(32)]
    assert filter_audit.positional_counts(some).tolist() == want


# --- page text ------------------------------------------------------------------------


PAGE = "page_id long, url string, html string"


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_article_of_marked_pages(spark, sf):
    """The given pages mark their article: its blocks, decoded, are the text."""
    import html as entities

    got = {r["page_id"]: r for r in QUERIES["op12_page_text"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", page["html"]).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["text"] == want
        assert got[page["page_id"]]["n_chars"] == len(want)


def read(markup):
    page = page_text.read(markup)
    return "\n".join(page.texts[i] for i in page_text.main_blocks(page, [0] * len(page.texts)))


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b <i>c</i>\n\t d<div>e</div>", "a\nb c d\ne"),
        ("<p>x &lt;b&gt; &#233;&#x1F600; &copy &nbsp; y</p>", "x <b> é😀 © y"),
        ("<p>one<br>two</p>", "one two"),
        ("<script>var a='<p>no</p>';</script><p>yes</p><style>p{}</style>", "yes"),
        ("<p>a<!-- <p>no</p> -->b</p><![CDATA[ c<d ]]>", "ab\nc<d"),
        ("<title>no</title><p>a < b and c</p>", "a < b and c"),
        ("<nav>menu</nav><header>top</header><p>text</p><aside>side</aside><footer>foot</footer>", "text"),
        ("<article><header><h1>Title</h1></header><p>text</p><footer>by</footer></article><p>after</p>", "Title\ntext"),
        ("<article>a<div class='ad-slot'>buy</div>b<section id=comments><article>me too</article></section></article>", "a\nb"),
        ("<body class=has-sidebar><div class=with-sidebar><article>a</article></div></body>", "a"),
        ("<form><label>name</label><input><button>go</button></form><p>text</p>", "text"),
        ('<p title="a > b" data-x=\'<p>\'>text</p>', "text"),
        ("<div role=navigation>x</div><main><p>text</p></main><p>other</p>", "text"),
        ("<p>shown</p><p hidden>hidden</p>", "shown"),
        ("<article><p>cut off he", "cut off he"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<div class='cookie notice'>We use cookies</div><div>text</div>", "text"),
        ("<p><b>bold<p>more</b> text", "bold\nmore text"),
    ],
)
def test_reading(markup, text):
    assert read(markup) == text


def bare(i, body):
    lead = "<div>Home News Sport Weather today here</div>"
    return f"<html><body>{lead}<div>{body}</div><div>All rights are held by this house</div></body></html>"


def test_a_host_repeats_its_boilerplate(spark):
    """Without any mark of the article, what is on other pages of the host goes."""
    rows = [(i, f"http://a.example/{i}", bare(i, f"<p>story number {i} has its very own words w{i}</p><p>and w{i}x</p>")) for i in range(40)]
    rows += [(100, "http://b.example/", bare(0, "<p>alone on its host</p>"))]
    got = texts(page_text.extracted(spark.createDataFrame(rows, PAGE)))
    for i in range(40):
        assert got[i] == f"story number {i} has its very own words w{i}\nand w{i}x"
    assert got[100].startswith("Home News") and "alone on its host" in got[100]


def test_copies_keep_their_text(spark):
    """A page whose whole text stands on others keeps what the fewest share."""
    story = "<p>the same long story that two pages of the house tell in full</p>"
    rows = [(i, "http://a.example/x", bare(i, f"<p>story number {i} has its very own words w{i}</p>")) for i in range(30)]
    rows += [(50, "http://a.example/y", bare(0, story)), (51, "http://a.example/z", bare(0, story) + "<p>w51 is a new word here</p>")]
    rows += [(52, "http://a.example/y", bare(0, story))]
    got = texts(page_text.extracted(spark.createDataFrame(rows, PAGE)))
    assert got[50] == got[52] == "the same long story that two pages of the house tell in full"
    assert got[51] == "w51 is a new word here"


def test_covered_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        least = int(rng.integers(1, 7))
        pages = [rng.integers(0, 3, rng.integers(0, 25)).tolist() for _ in range(int(rng.integers(1, 6)))]
        stream, owner = [], []
        for i, p in enumerate(pages):
            stream += [*p, 1000 + i]
            owner += [i] * (len(p) + 1)
        want = [0] * len(stream)
        grams = {}
        for s in range(len(stream) - least + 1):
            grams.setdefault(tuple(stream[s : s + least]), []).append(s)
        for places in grams.values():
            n = len({owner[s] for s in places})
            for s in places if n > 1 else ():
                for t in range(s, s + least):
                    want[t] = max(want[t], n)
        assert page_text.covered(np.array(stream), np.array(owner), least).tolist() == want


def test_shelves_are_bounded_and_whole(monkeypatch, spark):
    shelf = page_text.Shelf("h")
    monkeypatch.setattr(page_text, "SHELF", 100)
    closed = []
    for i in range(50):
        shelf.add({"page_id": i}, 30)
        if shelf.words > 200:
            closed.append(shelf.closed())
    assert [r["page_id"] for s in [*closed, shelf] for r in s.rows] == list(range(50))
    assert all(s.words <= 100 for s in closed) and shelf.words == sum(shelf.sizes)


def test_pages_of_different_shelves_share_a_passage(spark, monkeypatch):
    """A passage that only two pages of a host share is seen wherever the two are dealt."""
    monkeypatch.setattr(page_text, "SALTED", 4)
    own = lambda i: f"story number {i} has its very own words w{i}"
    body = lambda i: f"<div><p>{own(i)}</p><p>this notice stands on just two pages m{i // 2}</p></div>"
    rows = [(i, f"http://a.example/{i}", body(i)) for i in range(200)]
    # copies count as one page, here and on another host
    rows += [(300 + i, "http://a.example/c", body(14)) for i in range(3)]
    rows += [(400 + i, "http://b.example/c", body(14)) for i in range(3)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows meet in one task
    spark.conf.set(name, "false")
    try:
        got = {r["page_id"]: r for r in page_text.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    finally:
        spark.conf.unset(name)
    assert len(got) == 206
    assert [got[i]["text"] for i in range(200)] == [own(i) for i in range(200)]
    assert all(got[i]["n_repeated"] == 1 for i in range(200))
    assert {got[i]["text"] for i in (300, 301, 302)} == {own(14)}
    assert all(got[i]["text"].endswith("two pages m7") and got[i]["n_repeated"] == 0 for i in (400, 401, 402))


def test_notices_inside_articles(spark, monkeypatch):
    """What most articles of a host hold is a notice, wherever its pages are dealt; shared passages and copies stay."""
    monkeypatch.setattr(page_text, "SALTED", 4)
    notice, part = "Sign up to read more of this", "a passage that a third of the stories quote"
    story = lambda i: f"story number {i} has very many words of its own w{i}"
    body = lambda i: "".join(f"<p>{t}</p>" for t in [story(i)] + [part] * (i % 3 == 0) + [notice] * (i % 10 > 0))
    page = lambda i, text: (i, f"http://a.example/{i}", f"<nav>menu</nav><article>{text}</article>")
    rows = [page(i, body(i)) for i in range(60)]
    # an article that is little else, copies of one article, a host of few pages
    rows += [page(100, f"<p>{notice}</p><p>w100</p>")] + [page(200 + i, body(1)) for i in range(90)]
    rows += [(300 + i, f"http://b.example/{i}", f"<article>{body(i)}</article>") for i in range(1, 5)]
    got = texts(page_text.extracted(spark.createDataFrame(rows, PAGE)))
    for i in range(60):
        assert got[i] == "\n".join([story(i)] + [part] * (i % 3 == 0))
    assert got[100] == f"{notice}\nw100"
    assert {got[200 + i] for i in range(90)} == {story(1)}
    assert all(got[300 + i].endswith(notice) for i in range(1, 5))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://A.example/x", ""), (3, "no host", "<p>text</p>"), (None, None, "<p>text</p>"), (3, "no host", "<p>text</p>")]
    rows += [(4, "HTTP://A.EXAMPLE?x", "<p>" + "long words " * 60000 + "</p>"), (5, "://", "<")]
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 AS host", "2 AS salt", "3 AS draw", "4 AS texts", "'x' AS text")
    got = sorted((r["page_id"] or 0, r["text"]) for r in page_text.extracted(df).collect())
    assert got == [(0, "text"), (1, ""), (2, ""), (3, "text"), (3, "text"), (4, ("long words " * 60000).strip()), (5, "<")]
    assert page_text.extracted(spark.createDataFrame([], PAGE)).count() == 0


# --- vector codes ---------------------------------------------------------------------


def slow_codes(rows, rounds=4, entries=256):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[int(np.floor(1024 * float(x))) for x in r[1]] for r in kept]
    whole = [v + [0] * (-len(v) % 4) for v in whole]
    k = len(whole[0]) // 4
    parts = [[v[p * k : p * k + k] for v in whole] for p in range(4)]
    books = [list(ps[:entries]) for ps in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            owned = [near(x, books[p])[1] for x in parts[p]]
            for e in range(len(books[p])):
                members = [x for x, o in zip(parts[p], owned) if o == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = [[near(x, books[p]) for x in parts[p]] for p in range(4)]
    errors = [sum(found[p][i][0] for p in range(4)) for i in range(len(kept))]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(
        (repr(r[0]), "".join(f"{found[p][i][1]:02x}" for p in range(4)), errors[i], sums[r[2]], digest) for i, r in enumerate(kept)
    )


VECTORS = "vec_id long, embedding array<float>, label int"


def coded(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS v", "2 AS code", "3 AS draw", "4 AS _label")
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.codes(df).collect())


def test_codes_are_those_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ENTRIES", 9)
    monkeypatch.setattr(vector_codes, "OWNED", 20)
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=8) * 2).tolist(), int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 5) for i in range(60)]  # one large group
    rows += [(7, rows[3][1], 1), (7, rows[7][1], 1), (None, rows[5][1], None)]
    rows += [(-1, None, 0), (-2, [1.0, float("nan")] * 4, 0), (-3, [None] * 8, 0), (-4, [float("inf")] * 8, 0), (-5, [], 0), (2000, [1.0, 2.0], 0)]
    assert coded(spark, rows) == slow_codes(rows, entries=9)


def test_codes_of_few_odd_and_no_vectors(spark):
    rows = [(1, [0.5, -0.25, 3.0, 1.0, 2.0], 1), (2, [0.5, -0.25, 3.0, 1.0, 2.5], 1), (3, [1e6, -70000.0, 0.0, 0.0, 0.0], 2)]
    assert coded(spark, rows[:2]) == slow_codes(rows[:2])
    assert len(coded(spark, rows)) == 3
    assert coded(spark, []) == []


def test_only_moving_parts_are_dealt_again(spark, monkeypatch):
    """After the first round the shuffles take the parts that change their entry, and none else."""
    sent = []
    dealt = vector_codes._dealt
    monkeypatch.setattr(vector_codes, "_dealt", lambda parts, counts: sent.append(parts.count()) or dealt(parts, counts))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 8))
    rows = [(i, np.float32(centres[i % 300] + rng.normal(size=8) * 1e-3).tolist(), 0) for i in range(1200)]
    vector_codes.fit(spark.createDataFrame(rows, VECTORS))
    assert sent[0] == 4 * 1200 and len(sent) == 4
    assert all(n < sent[0] / 4 for n in sent[1:])


def test_nearest_in_both_number_kinds():
    rng = np.random.default_rng(2)
    for most in (1 << 10, 1 << 26):
        x, c = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (20, 16))
        near, far = vector_codes.nearest(x, np.concatenate([c, c]))
        want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert near.tolist() == want.argmin(axis=1).tolist()
        assert far.tolist() == want.min(axis=1).tolist()


def test_the_new_queries_have_sql():
    assert {"op11_filter_audit", "op13_vector_codes"} <= set(ORACLE)


# --- shingle join: tiles --------------------------------------------------------------


def tile_table(sizes, comps=None):
    """Tiles of equal sets, one after the other."""
    import pyarrow as pa

    from trackweave.llm import shingle_join

    part = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 20, dtype=np.uint64))
    key = np.repeat(np.arange(len(sizes)), sizes)
    n = len(key)
    node = np.arange(n)
    zeros = np.zeros(n, dtype=np.int32)
    return pa.table(
        {
            "key": key, "band": zeros, "lo": zeros, "hi": zeros, "node": node, "n": np.full(n, 20, dtype=np.int32),
            "comp": node if comps is None else np.array(comps), "own": np.ones(n, dtype=np.int32), "block": zeros,
            "bits": pa.array([shingle_join.bitmap(part)] * n, pa.binary()),
            "least": pa.array([np.zeros(shingle_join.FEW, dtype=np.uint64).tobytes()] * n, pa.binary()),
        }
    )


@pytest.mark.parametrize("together", [4, 48])
def test_first_round_gives_fewer_pairs_than_rows(monkeypatch, together):
    """A tile of m components gives m - 1 pairs that tie it together; the last round gives every pair across components."""
    from trackweave.llm import shingle_join

    monkeypatch.setattr(shingle_join, "TOGETHER", together)
    sizes = [1, 2, 3, 30, 70]
    tiles = shingle_join.Tiles(shingle_join.Threshold(), tile_table(sizes))
    key = tiles.at["key"]
    few = [np.concatenate(c) for c in zip(*tiles.pairs(True))]
    assert len(few[0]) == sum(m - 1 for m in sizes) and (key[few[0]] == key[few[1]]).all()
    roots = shingle_join._roots(len(key), *few)
    assert len(np.unique(roots)) == len(sizes)
    every = [np.concatenate(c) for c in zip(*tiles.pairs(False))]
    assert len(set(map(tuple, np.sort(np.column_stack(every), axis=1).tolist()))) == len(every[0]) == sum(m * (m - 1) // 2 for m in sizes)
    known = shingle_join.Tiles(shingle_join.Threshold(), tile_table([6, 5], [0, 0, 0, 1, 1, 1, 7, 7, 7, 7, 7]))
    assert sum(len(x) for x, _ in known.pairs(True)) == 1 and sum(len(x) for x, _ in known.pairs(False)) == 9


def test_pairs_are_given_in_the_first_tile_of_the_few():
    """Rows that share three of their few shingles meet in three tiles and are given once; others in every tile."""
    import pyarrow as pa

    from trackweave.llm import shingle_join

    few = np.array([11, 22, 33, 44], dtype=np.uint64)
    keys = np.array([11, 22, 33, 77], dtype=np.int64)
    table = tile_table([2, 2, 2, 2])
    rows = {c: table.column(c) for c in table.schema.names} | {"key": np.repeat(keys, 2), "node": np.tile([5, 6], 4), "comp": np.tile([5, 6], 4)}

    def given(other):
        least = [few.tobytes(), np.array(other, dtype=np.uint64).tobytes()] * 4
        tiles = shingle_join.Tiles(shingle_join.Threshold(), pa.table(rows | {"least": pa.array(least, pa.binary())}))
        return sum(len(x) for x, _ in tiles.pairs(False))

    before = {int(k) for k in few[:3] if shingle_join._order(np.array([k], dtype=np.uint64)) < shingle_join._order(np.array([77], dtype=np.uint64))}
    assert given([11, 22, 33, 55]) == (1 if before else 2)
    assert given([1, 2, 3, 0]) == 4


def test_pairs_beyond_the_few_are_given_once():
    """Rows whose few least shingles all differ, and that share seven others of the first ones, are given once, not in seven tiles."""
    import pyarrow as pa

    from trackweave.llm import shingle_join

    rule, rng = shingle_join.Threshold(), np.random.default_rng(3)
    some = rng.integers(0, 1 << 40, 15, dtype=np.uint64)
    some = some[np.argsort(shingle_join._order(some))]
    rest = rng.integers(1 << 62, 1 << 63, 29, dtype=np.uint64)
    sets = [np.sort(np.concatenate([own, some[8:], rest])) for own in (some[0:8:2], some[1:8:2])]
    batch = pa.RecordBatch.from_pydict({"node": [5, 6], "part": pa.array([s.tobytes() for s in sets], pa.binary())})

    class Sent:
        value = np.zeros(shingle_join.CELLS, dtype=bool)

    marks = pa.Table.from_batches([*shingle_join._marked(Sent, rule)([batch])])
    keys = some[8:].view(np.int64)
    table = tile_table([2] * len(keys))
    rows = {c: table.column(c) for c in table.schema.names} | {"key": np.repeat(keys, 2)}
    rows |= {c: np.tile([5, 6], len(keys)) for c in ("node", "comp")} | {"n": np.full(2 * len(keys), 40, dtype=np.int32)}
    rows |= {c: pa.array(marks.column(c).to_pylist() * len(keys), pa.binary()) for c in ("bits", "least")}
    assert sum(len(x) for x, _ in shingle_join.Tiles(rule, pa.table(rows)).pairs(False)) == 1


@pytest.mark.parametrize("most", [0, 1 << 40])
def test_sets_are_fetched_alike_either_way(spark, monkeypatch, most):
    """Ids sent to the tasks or, beyond the bound, joined: the same components."""
    from trackweave.llm import shingle_join

    monkeypatch.setattr(shingle_join, "MOST_SENT", most)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:78] + [f"x{i}", f"y{i}"])) for i in range(12)] + [(50 + i, " ".join(f"z{i}{k}" for k in range(30))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.near_classes(docs).collect()}
    assert got == {i: 0 if i < 12 else i for i, _ in rows}


def test_whole_runs_keep_groups_together():
    import pyarrow as pa

    from trackweave.llm.runs import whole_runs

    keys = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 3]), "v": pa.array(range(i, min(len(keys), i + 3)))}) for i in range(0, len(keys), 3)]
    tables = list(whole_runs(iter([batches[0].slice(0, 0), *batches]), ["k"]))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(len(keys)))
    for a, b in zip(tables, tables[1:]):
        assert not set(a.column("k").to_pylist()) & set(b.column("k").to_pylist())


# --- SentencePiece: the way in use ----------------------------------------------------


def test_parts_are_remembered_in_bounded_buffers(spark, documents, monkeypatch):
    """Forgetting and learning anew, lot by lot, changes no id; decoding gives the texts back."""
    import pyarrow as pa

    from trackweave.llm import pieces
    from trackweave.llm.piece_model import TOKENIZER, model_bytes

    data = model_bytes(spark, TOKENIZER)
    texts = [r["text"] for r in documents.select("text").limit(60).collect()]
    column = pa.array(texts, pa.string())

    def ids():
        pieces.by_parts.cache_clear()
        coder = pieces.by_parts(data)
        out, back = [], []
        for _ in range(2):
            for _, found, at, some in pieces._ids(column, data):
                out += [found[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
                back += some
        return out, back, coder

    want, back, _ = ids()
    assert back == texts + texts
    monkeypatch.setattr(pieces, "MOST_KNOWN", 1000)
    monkeypatch.setattr(pieces, "LOT", 7)
    again, _, coder = ids()
    assert again == want
    pieces.compare(data, pieces.PROBES + texts[:5])
    plain = [i for _, found, at, some in pieces._ids(column, data, False) for i in found.tolist() if not some]
    assert plain == [i for x in want[: len(texts)] for i in x]
