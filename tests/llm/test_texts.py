"""Passage removal, similarity join, WARC, page text, quality, pipeline."""

import io
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from dataloom.llm import html_text, quality, shingle_join, signature_tree, substring_dedup, warc
from dataloom.llm.common import components
from dataloom.llm.suffix_automaton import SuffixAutomaton
from dataloom.llm.words import chunks, shingle_sets
from tests.llm import brute

SCHEMA = "doc_id long, text string, n_words string, component_id string, start int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA)


def corpus(seed, vocabulary=40, n=80):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [" ".join(word() for _ in range(r.randrange(10, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(0, 30))) for _ in range(3)]
        for k in range(2):
            if r.random() < 0.5:
                parts.insert(k + 1, r.choice(passages))
        out.append((r.randrange(10_000) * 100 + i, r.choice([" ", "\n", "\t "]).join(parts)))
    out += [(10**7 + i, out[3][1]) for i in range(12)]
    out += [(1, ""), (2, None), (3, " \n "), (4, "w1 " * 300), (5, "w1 " * 14), (6, passages[0] + " " + passages[0])]
    return out


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 40), (2, 3000), (3, 4)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, vocabulary):
    if seed == 1:  # every path: frequent minimizers, runs cut into windows, tiny shards
        monkeypatch.setattr(substring_dedup, "FREQUENT", 1)
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
        monkeypatch.setattr(substring_dedup, "MOST_WORDS", 50)
    if seed == 3:
        monkeypatch.setattr(substring_dedup, "MOST_WORDS", 500)
    rows = corpus(seed, vocabulary)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute.repeats(rows)


def test_repeats_in_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (2, text), (2, text), (1, "short"), (3, text + " end")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 20, 0), (2, 20, 0), (2, 20, 0), (1, 1, 0), (3, 21, 20)], key=str)
    assert substring_dedup.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_repeats_in_long_texts(spark):
    """Texts of very many words, and ids that repeat: each row loses what smaller ids have, its own id's rows no one's."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(5, "same " * 30_000), (3, "same " * 20_000), (8, " ".join(base)), (9, " ".join(base[30_000:] + ["end"] * 20)), (2, " ".join(base[100:140]))]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute.repeats(rows)
    a, b = " ".join(base[:20]), " ".join(base[20:40])
    rows = [(4, a + " x"), (4, b + " y"), (6, a), (7, b), (4, a + " z")]
    got = sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == [(4, 21, 0), (4, 21, 0), (4, 21, 0), (6, 20, 20), (7, 20, 20)]


def test_what_is_removed_comes_from_automata(spark, monkeypatch):
    """Without the shards' automata nothing goes; with them the first document of every window is right."""
    rows = corpus(5, 300)
    real = substring_dedup.match_shards
    monkeypatch.setattr(substring_dedup, "match_shards", lambda classes, length: real(classes, length).limit(0))
    assert sum(x["n_removed"] for x in substring_dedup.remove_repeats(docs(spark, rows)).collect()) == 0
    classes = spark.createDataFrame([(1, "a b c d e", 7, 9), (1, "x b c d", 3, 3), (2, "a b c", 1, 1), (3, "q q q q", 4, 5)], "route long, words string, first_id long, last_id long")
    got = {(x["route"], x["words"]): x["firsts"] for x in real(classes, 3).collect()}
    assert got[1, "a b c d e"] in ([1, 3, 7], [7, 3, 7]) and got[3, "q q q q"] == [4, 4] and (2, "a b c") not in got
    got = {(x["route"], x["words"]): x["firsts"] for x in real(classes, 3, 1).collect()}
    assert got == {(1, "a b c d e"): [7, 3, 7], (3, "q q q q"): [4, 4]}


def test_automaton_against_search():
    r = random.Random(4)
    seqs = [([r.choice("abc") for _ in range(r.randrange(0, 25))], k) for k in range(12)]
    a = SuffixAutomaton(seqs)
    has = lambda s, part: any(s[i:i + len(part)] == part for i in range(len(s) - len(part) + 1))
    for _ in range(20):
        q = [r.choice("abcd") for _ in range(20)]
        for k, (n, least) in enumerate(a.statistics(q, 5)):
            best = max((m for m in range(0, min(5, k + 1) + 1) if m == 0 or any(has(s, q[k + 1 - m:k + 1]) for s, _ in seqs)))
            assert n == best
            if n:
                assert least == min(o for s, o in seqs if has(s, q[k + 1 - n:k + 1]))


def test_automaton_calls_no_function_a_word():
    """Shards are most of op2's CPU time: states are made and streamed in one loop; only clones are calls."""
    r = random.Random(6)
    seqs = [([f"w{r.randrange(5000)}" for _ in range(30)], k) for k in range(200)]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        a = SuffixAutomaton(seqs)
        firsts = [list(a.statistics(words, 13)) for words, _ in seqs]
    finally:
        sys.setprofile(None)
    assert all(n == min(i + 1, 13) for x in firsts for i, (n, _) in enumerate(x)) and all(x[12][1] == k for k, x in enumerate(firsts))
    assert len(calls) < 6000


def test_joined_texts():
    """Runs are cut from texts whose words one space parts, also where texts meet without one."""
    texts = ["  a b", "c\t\n d ", None, "", " \r\n", "e", "f\x0bgé\x0c\x0c\u00a0h", "i  j"]
    ((at, words),) = chunks(pa.array(texts))
    data, begin, end = words.joined()
    want = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert at == 0 and [data[a:z].decode() for a, z in zip(begin, end)] == sum(want, [])
    assert [data[begin[a]:end[z - 1]].decode() if z > a else "" for a, z in zip(words.first[:-1], words.first[1:])] == [" ".join(w) for w in want]
    assert [x for _, w in chunks(pa.array(["", None])) for x in (w.joined()[0], len(w.joined()[1]))] == [b"", 0]


def near(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(8):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 15, 60, 150, 900]))]
        for _ in range(r.choice([1, 2, 9, 30])):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 18))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(" ".join(t))
    out += ["", None, "a b", "A B", "a  b\n", "É x y", "é x y"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, 2000), (5, 80, 2000), (3, 90, 4)])
def test_join_matches_brute_force(spark, monkeypatch, n, num, block):
    monkeypatch.setattr(shingle_join, "LEAST_BLOCK", block)
    monkeypatch.setattr(shingle_join, "MOST_BLOCK", block)
    rows = near(n + num)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.shingle_components(docs(spark, rows), n, num).collect()}
    assert got == brute.components(rows, n, num)


def test_linked_sets_share_a_key():
    r = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        for size in (9, 20, 70, 100, 300, 1500, 5000):
            for _ in range(20):
                x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
                least = -(-num * len(x) // den)  # as far apart as a link allows
                y = np.sort(r.choice(x, least, replace=False))
                assert signature_tree.linked(x, y, num, den)
                assert np.intersect1d(shingle_join.candidate_keys(x, num, den), shingle_join.candidate_keys(y, num, den)).size


def test_bitmaps_exclude_no_link():
    r = np.random.default_rng(8)
    for num in (80, 90):
        for size in (9, 100, 600, 5000):
            x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            y = np.sort(r.choice(x, -(-num * len(x) // 100), replace=False))
            z = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            sets = [x, z, y]
            got = signature_tree.may_link([len(s) for s in sets], [signature_tree.bitmap(s, signature_tree.small_bits(len(s))).tobytes() for s in sets], num, 100)
            assert got[0] == got[2] and (size < 100 or got[1] != got[0])


def test_links_at_the_threshold_are_found(spark):
    """Pairs as far apart as a link allows, and one token farther, of sets from 100 to 5,000 shingles."""
    r = random.Random(12)
    rows, linked = [], 0
    for k, (n, size) in enumerate([(5, 100), (5, 700), (5, 5000), (5, 2000)]):
        base = [f"w{r.randrange(10**9)}" for _ in range(size + n - 1)]
        # Cut from the end: the shorter text's shingles are all in the longer one.
        for extra in (0, 1):
            keep = -(-80 * size // 100) - extra
            text = [f"{k}{extra}{w}" for w in base]
            rows += [(4 * k + 2 * extra, " ".join(text)), (4 * k + 2 * extra + 1, " ".join(text[:keep + n - 1]))]
            linked += not extra
    got = {x["doc_id"]: x["component_id"] for x in shingle_join.shingle_components(docs(spark, rows), 5, 80).collect()}
    assert sum(got[i] == i - 1 for i in got if i % 2) == linked and all(got[i] == i - (i % 4 == 1) for i in got)


def test_tree_excludes_no_link():
    r = np.random.default_rng(6)
    base = [np.unique(r.integers(0, 2**63, 120).astype(np.uint64)) for _ in range(10)]
    sets = [np.unique(np.concatenate([b[:int(r.integers(100, 120))], r.integers(0, 2**63, int(r.integers(0, 12))).astype(np.uint64)])) for b in base for _ in range(9)]
    t = signature_tree.Tree(sets, 512)
    may = {(i, int(j)) for i, js in signature_tree.pairs_that_may_link(t, t, 90, 100) for j in js}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if signature_tree.linked(sets[i], sets[j], 90, 100)}
    assert want and want <= may and len(may) < len(sets) ** 2 / 4


def test_join_of_odd_tables(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "other words in this one here"), (9, "A b c d e f"), (None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingle_join.shingle_components(docs(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (9, 4), (None, None)], key=str)
    assert shingle_join.shingle_components(docs(spark, rows).limit(0)).count() == 0
    kept = shingle_join.drop_near_copies(docs(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (7, "z")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7] and kept.columns == docs(spark, []).columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (5, 39), (None, 3), (3, None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


def test_shingles_of_many_texts_at_once():
    import pyarrow as pa
    texts = ["A b c", None, "", "x", "ÀÉ ß y z", "a b c d\x0be"]
    got = [s for _, w in chunks(pa.array(texts), lower=True, most=4) for s in shingle_sets(w, 3)]
    assert [len(s) for s in got] == [1, 0, 0, 1, 1, 3] and set(got[0]) <= set(got[5])


PAGES = "page_id long, url string, html string, kind string, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 0) for i, u, h in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (9, "u", "<p>é</p>")]
    files = warc.write_archives(pages(spark, rows), f"file://{tmp_path}/w")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(files).where("kind = 'record'").collect()), key=str)
    assert got == sorted([(1, "revisit", 9, 9), (4, "revisit", 9, 9), (9, "response", None, 9), (None, "revisit", 9, 9), (2, "revisit", 3, 0), (3, "response", None, 0), (5, "response", None, 300_000), (5, "response", None, 300_000)], key=str)
    assert warc.read_archives(warc.write_archives(pages(spark, []), f"file://{tmp_path}/e")).count() == 0
    r = next(r for r in warc.read_archives(files).collect() if r["page_id"] == 9)
    assert bytes(r["payload"]) == "<p>é</p>".encode() and r["payload_digest"] == warc.sha1_base32("<p>é</p>".encode())


def test_small_payloads_are_no_revisits(spark, tmp_path):
    files = warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), f"file://{tmp_path}/w", least_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_archives(files, payloads=False).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "length", "none"])
def test_salvage(compressed, damage):
    pack = warc.member if compressed else bytes
    parts = [pack(warc.record(i, f"http://x/{i}", (f"page {i} " * 200).encode())) for i in range(6)]
    bad = bytearray(parts[2])
    if damage == "flip":
        bad[len(bad) // 2] ^= 0xFF
    elif damage == "cut":
        bad = bad[:len(bad) // 2]
    elif damage == "length":
        raw = warc.record(2, "u", b"abc")
        n = int(raw.rsplit(b"Content-Length: ", 2)[1].split(b"\r\n")[0])
        bad = bytearray(pack(raw.replace(b"Content-Length: %d\r\n\r\nHTTP" % n, b"Content-Length: %d\r\n\r\nHTTP" % (n + 10_000_000))))
    middle = bytes(bad) + (b"\x00garbage\x1f\x8b\x08" if damage == "junk" else b"")
    data = b"".join(parts[:2]) + middle + b"".join(parts[3:])
    found = list(warc.salvage(io.BytesIO(data)))
    ids = [warc.ID.search(f[3][0]["warc-record-id"])[1] for f in found if f[0] == "record"]
    assert ids == [str(i) for i in range(6) if i != 2 or damage in ("none", "junk")]
    gaps = [f for f in found if f[0] == "gap"]
    assert len(gaps) == (damage != "none") and sum(f[2] for f in found) == len(data)


@pytest.mark.parametrize("pack", [warc.member, bytes])
def test_records_of_long_urls(pack):
    urls = ["data:," + "x" * 3_000_000, "u" + " " * 30_000, "short"]
    found = list(warc.salvage(io.BytesIO(b"".join(pack(warc.record(i, u, b"abc")) for i, u in enumerate(urls)))))
    assert [f[0] for f in found] == ["record"] * 3 and found[0][3][0]["warc-target-uri"] == urls[0]


def test_query_fails_on_gaps(spark, sf, tmp_path, monkeypatch):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record(1, "u", b"abc")) + b"junk")
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    monkeypatch.setattr(warc, "write_archives", lambda *_: archives)
    with pytest.raises(Exception, match="gap in a new archive"):
        warc.query(spark, sf).collect()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><nav><ul><li>Home</ul></nav><header>Site</header>
<div class="ad">buy</div><div id="cookie-notice">cookies</div><article><h1>Head &lt;1&gt;</h1><p><b>One
 two.<br>three<p>Four&nbsp;five &eacute;<!-- no --><script>x()</script></p><form>q</form><aside>see</aside><ul><li>i1<li>i2</ul><div class="comments"><p>reader</p></div></article><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(html_text.tree(PAGE)) == "Head <1>\nOne two. three\nFour five é\ni1\ni2"
    assert html_text.main_text(html_text.tree("")) == "" and html_text.main_text(html_text.tree("plain < text & more")) == "plain < text & more"
    assert html_text.main_text(html_text.tree("<p>a<p>b")) == "a\nb"


def test_classes_of_the_whole_page_drop_nothing():
    page = '<html class="no-banner"><body class="has-sidebar"><div class="sidebar">x</div><main id="main-menu"><p>kept</p></main></body></html>'
    assert html_text.main_text(html_text.tree(page)) == "kept"


@pytest.mark.parametrize(("page", "want"), [
    ("<article class='hentry category-social-media'><p>kept</p></article>", "kept"), ("<article class='post no-comments'>kept</article>", "kept"),
    ("<article class='social'>kept</article>", "kept"), ("<div class='content has-sidebar'><article>kept</article></div>", "kept"),
    ("<div class='sidebar'><div><main>kept</main></div></div>", "kept"), ("<div class='with-sidebar'><main>kept</main></div>", "kept"),
    ("<article>a<section id='related-work'>b</section><div class='related-posts'>no</div><div class='x cookie-notice'>no</div></article>", "a\nb"),
    ("<main>a</main><div>no</div><main>b</main><div role='main'>c</div>", "a\nb\nc"),
    ("<main><h1>t</h1><article>a</article><p>b</p><article>c</article></main>", "t\na\nb\nc"), ("<article>a</article><main>b</main>", "a\nb"),
    ("<article>a<div class='comments'><article>no</article></div></article><div id='comments'><article class='comment'>no</article></div>", "a"),
    ("<div class='comments'><article class='comment'>a</article><article class='comment'>b</article></div>", "a\nb"),
    ("<nav class='x'><article>no</article></nav><div class='menu'>no</div><article>a</article>", "a"),
])
def test_no_class_discards_an_article(page, want):
    assert html_text.main_text(html_text.tree(page)) == want


def test_templates_go_and_articles_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Welcome to our shop</div><div>text {i}</div><p>repeated passage</p></body>") for i in range(20)]
    rows += [(100 + i, f"http://g.example/{i}", f"<body><div>Welcome</div><article><p>repeated passage</p><p>n {i}</p></article></body>") for i in range(20)]
    rows += [(200 + i, "http://c.example/x", "<body><div>one page only</div></body>") for i in range(20)]  # copies of one page
    rows += [(300, None, None), (301, "no url", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows)).collect()}
    assert got[3] == "text 3" and got[103] == "repeated passage\nn 3" and got[203] == "one page only" and got[300] == got[301] == ""
    assert html_text.extract(pages(spark, rows).limit(0)).count() == 0


def test_templates_inside_articles_go(spark):
    box = "<div class='x7'><p>Get our letter</p></div><ul><li>Home<li>About</ul>"
    quote = "<p>quoted passage</p><blockquote><div>quoted lines</div></blockquote>"
    rows = [(i, f"http://h.example/{i}", f"<body><article>{box}<p>n {i}</p>{quote}</article></body>") for i in range(20)]
    rows += [(100 + i, f"http://g.example/{'news/' if i < 10 else 'x' if i < 80 else 'old/'}{i}", f"<body><main>{'<div>Section note</div>' if i < 10 else ''}<p>n {i}</p></main></body>") for i in range(90)]
    rows += [(200 + i, f"http://c.example/{i}", f"<body><div>visit {i}</div><article><div>one article at many addresses</div></article></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows)).collect()}
    rows = [(i, f"http://h.example/{i}", f"<main><p>visit {i}</p><div><article>a story</article></div></main>") for i in range(20)]
    assert {r["text"] for r in html_text.extract(pages(spark, rows)).collect()} == {f"visit {i}\na story" for i in range(20)}
    assert got[3] == "n 3\nquoted passage\nquoted lines" and got[103] == "n 3" and got[203] == "one article at many addresses"


@pytest.mark.parametrize("tag", ["div", "span", "font", "article", "blockquote"])
def test_deep_pages(tag):
    page = "<main>" + f"<{tag}>a " * 100_000 + "</b><hr><li>" * 1_000
    root = html_text.tree(page)
    assert html_text.main_text(root, frozenset({1})).split() == ["a"] * 100_000 and len(html_text.subtrees(root)) == 3


def test_odd_pages_are_read_in_no_time():
    import time
    deep, unclosed = "<div>" * 100_000 + "a" + "</div>" * 50_000, "<a " * 350_000
    for page, want in ((deep, "a"), (unclosed, unclosed.strip()), (unclosed + '">x', "x"), ("<p title='" * 100_000 + ">y", "y"), ("<!-- " * 200_000, ""), ("<" * 10**6, "<" * 10**6), ("<script>" * 10**5, ""), ("</" * 500_000, "")):
        t = time.perf_counter()
        assert html_text.main_text(html_text.tree(page)) == want
        html_text.subtrees(html_text.tree(page))
        assert time.perf_counter() - t < 8  # a second or less on an idle machine


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a < b and c<d>e</p>", "a < b and ce"), ('<p title="x>y">z</p>', "z"), ("<p a='\">'>q</p>", "q"), ("x<!-- > -->y<!doctype z>w", "xyw"), ("<p>1<p 2", "1<p 2"), ("a</ b>c", "ac"), ("a<?php x ?>b<", "ab<"),
    ('<article><div class="share-prices"><p>Shares rose</p></div><section id="related-work"><p>Others</p></section></article>', "Shares rose\nOthers"), ("<P>A<BR/>B<IMG SRC=x>C", "A BC"),
])
def test_tags_and_text(page, want):
    assert html_text.main_text(html_text.tree(page)) == want


def test_subtrees_match_a_plain_count(spark, sf):
    """Of the given pages: for each host and section, on how many different pages a block is, by comparing written-out subtrees."""
    from collections import defaultdict

    from pyspark.sql import functions as F

    def written(e):
        return (e.tag, tuple(written(x) if isinstance(x, html_text.Element) else " ".join(x.split()) for x in e.parts))

    table = spark.read.parquet(f"{sf}/pages.parquet").withColumn("html", F.coalesce("html", F.lit("")))
    rows = table.collect()
    want = defaultdict(set)
    for x in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(?:/([^/?#]*)/)?", x["url"] or "")
        host, folder = (m[1].lower(), m[2] or "") if m else ("", "")
        root = html_text.tree(x["html"])
        article = {id(e) for top in html_text._main_parts(root) if top is not root for e in html_text._all(top)}
        for e in html_text._all(root):
            if e.tag in html_text.BLOCK and id(e) not in article and not any(id(y) in article for y in html_text._all(e)):
                for site in (host, f"{host}/{folder}"):
                    want[site, written(e)].add(x["html"])
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), html_text.HOST, 1))
    keyed = table.select(host.alias("host"), F.concat(host, F.lit("/"), F.regexp_extract(F.coalesce("url", F.lit("")), html_text.FOLDER, 1)).alias("section"), "html")
    got = html_text.subtree_pages(keyed).where("not inside and subtree <> 0").collect()
    count = lambda pairs: sorted((site, n) for site, n in pairs)
    holders = {"html", "body"}  # they hold the article, which the hash leaves out and written() does not
    want = count((site, len(v)) for (site, w), v in want.items() if w[0] not in holders)
    held = {r for r in got}
    got = count((r["site"], r["pages"]) for r in held)
    # Blocks that hold the article are counted by Spark, too: at most the page's html and body.
    from collections import Counter
    more = Counter(got) - Counter(want)
    assert want and not Counter(want) - Counter(got) and sum(more.values()) <= 4 * len(rows)


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "http://h/a", "<p>x</p>")] * 3 + [(None, None, None), (2, "odd url", "<article>y" + "<p>z" * 20_000)]
    table = spark.createDataFrame([(*r, "q", 1, "h", "t") for r in rows], "page_id long, url string, html string, text string, n_chars int, host string, template string")
    got = sorted(((r["page_id"], r["n_chars"]) for r in html_text.extract(table).collect()), key=str)
    assert got == sorted([(1, 1)] * 3 + [(None, 0), (2, 1 + 2 * 20_000)], key=str)


def test_templates_outside_articles_are_found_by_few_pages(spark):
    rows = [(i, f"http://h.example/{i}", f"<div>menu of many<ul><li>one</li></ul></div><div><p>prose {i}</p><p>said {i % 7}</p></div>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {i: f"prose {i}\nsaid {i % 7}" for i in range(60)}


def good(r, n=60):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def labelled(spark, n=400):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        t, q = good(r), 1
        if i % 4 == 0:
            t, q = [t.upper().replace(" ", "!! "), " ".join([t.split()[0]] * 60), t.replace(" ", "*** ")][i % 3], 0
        rows.append((i, t, f"s{i % 5}", "en" if i % 2 else None, "x"))
        labels.append((i, q))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_quality_on_held_out(spark):
    df, labels, truth = labelled(spark)
    model = quality.train(df, labels.where("doc_id % 2 = 0 or doc_id % 8 = 4"))
    got = {r["doc_id"]: r["keep"] for r in quality.classify(df, model).collect()}
    held = [i for i in truth if i % 2 and i % 8 != 4]
    assert sum(got[i] == bool(truth[i]) for i in held) >= 0.98 * len(held)
    kept = quality.drop_rejected(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_sites_shrink_towards_what_is_above(spark):
    df, labels, _ = labelled(spark)
    model = quality.train(df, labels)
    bad = spark.createDataFrame([(10_000 + i, "AB!! CD!! " * 30, "bad", "en", "x") for i in range(200)] + [(20_000, "AB!! CD!! " * 30, "rare", "en", "x")], df.schema)
    got = {(r["host"], r["path"]): r["path_posterior"] for r in quality.classify(df.unionByName(bad), model).collect()}
    assert got[("bad", "en")] < got[("rare", "en")] < got[("s1", "en")]


def test_the_end_of_a_text_is_in_a_stretch():
    import pyarrow as pa
    clean = "word " * 47
    (_, x), (_, y) = ((None, quality.features(w)) for t in (clean + "JUNK " * 15, clean + "junk " * 15) for _, w in chunks(pa.array([t])))
    i = quality.FEATURES.index("worst_upper")
    assert x[0][i] > 0.4 and y[0][i] == 0


def test_quality_of_odd_tables(spark):
    df, labels, _ = labelled(spark, 40)
    none = quality.train(df, labels.limit(0))
    assert all(r["keep"] for r in quality.classify(df, none).collect())
    odd = spark.createDataFrame([(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "", "s", "en", "x")], df.schema)
    assert quality.classify(odd, quality.train(df, labels)).count() == 3
    assert quality.classify(df.limit(0), none).count() == 0


def judged(model, rows):
    """brute.site_posteriors of rows (source, lang, text) by their plain features."""
    x = np.array([brute.quality_features(t) for *_, t in rows])
    return brute.site_posteriors([(s, g, float(o)) for (s, g, _), o in zip(rows, model.log_odds(x), strict=True)])


def test_quality_matches_brute_force(spark, sf):
    """Every document of the given table: features word by word, posteriors by loops."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [tuple(r) for r in table.select("source", "lang", "text", "doc_id").collect()]
    want = dict(zip((r[3] for r in rows), judged(model, [r[:3] for r in rows]), strict=True))
    got = {r["doc_id"]: (r["host_posterior"], r["path_posterior"], r["p_good"]) for r in quality.classify(table, model).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)


def test_pipeline_matches_brute_force(spark, sf):
    """The rows of the whole pipeline, each stage done again in plain Python on all that the one before it kept."""
    import hashlib
    from array import array
    from collections import Counter

    import corpus_pipeline
    from tests.llm.test_exact import plain_encoding
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [tuple(r) for r in table.select("doc_id", "text", "source", "lang").collect()]
    text, source = {r[0]: r[1] or "" for r in rows}, {r[0]: r[2] for r in rows}
    good = judged(model, [(s, g, t) for _, t, s, g in rows])
    assert min(abs(p - quality.THRESHOLD) for *_, p in good) > 1e-5  # none is so near the threshold that rounding decides
    left = {r[0] for r, (*_, p) in zip(rows, good, strict=True) if p >= quality.THRESHOLD}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    left = [i for i, (_, c) in brute.components([(i, text[i]) for i in first.values()], 5, 80).items() if i == c]
    times = brute.mixed([(i, source[i], len(brute.words(text[i]))) for i in left])
    enc, want = plain_encoding(), Counter()
    for i, n in times.items():
        ids = enc.encode_ordinary(text[i])
        want[i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), brute.sha(text[i])] += n
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert len(left) < len(first) < len(rows) and got == want
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_drop_single_rows(spark):
    import corpus_pipeline
    schema = "doc_id long, text string, source string, lang string, keep string"
    some = lambda rows: spark.createDataFrame([(i, t, "s", "en", "x") for i, t in rows], schema)
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    twice = some([(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a b"), (3, "c"), (3, "d"), (3, "c"), (None, "e"), (None, "e"), (None, "a b")])
    got = corpus_pipeline.drop_exact_copies(spark, twice, "")
    assert got.columns == twice.columns and sorted(re.sub(" +", " ", t) for _, t in left(got)) == ["a b", "c", "d", "e"] and left(got)[0][0] == 1
    near = some([(5, "a b c d e f"), (5, "other words stand in this one"), (2, "A b c d e f"), (7, "u v w x y z"), (7, "U v w x y z"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "Q r s t u v")])
    got = corpus_pipeline.drop_near_copies(spark, near, "")
    assert [(i, t.lower()) for i, t in left(got)] == [(2, "a b c d e f"), (5, "other words stand in this one"), (7, "u v w x y z"), (None, "q r s t u v")]
    df, labels, _ = labelled(spark)
    model = quality.train(df, labels)
    bad = "AB!! CD!! " * 30
    mixed = df.unionByName(some([(1, bad), (None, bad), (None, bad)]))
    assert bad not in {r["text"] for r in quality.drop_rejected(mixed, model).collect()}


def test_queries_are_registered():
    from dataloom.llm import queries
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
