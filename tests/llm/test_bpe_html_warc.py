import os
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from normlens.llm import byte_bpe as B
from normlens.llm import html_extract as H
from normlens.llm import warc as W
from normlens.session import scratch_path


def test_ids_match_tiktoken_and_round_trip():
    table = B.merge_table(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), 97, 32, 10, r.randrange(160, 0x3000), 0x1F600]))
                     for _ in range(r.randrange(0, 300))) for _ in range(300)] + ["", "a" * 3000, " " * 500, "abab" * 500]
    ids, counts = B.encode_texts(texts, table, P.PATTERN)
    end = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(end[:-1], end[1:])] == [enc.encode_ordinary(t) for t in texts]
    assert B.decode_ids(ids, table) == "".join(texts).encode()


def test_article_text_only():
    page = ("<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>menu</a></nav><!-- x -->"
            "<div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three <b>four</b></p>"
            "<div id=comments><p>me too</p></div></article><footer>&copy;</footer>")
    assert H.main_text(H.page_lines(page), None) == "A & B one two three four"


def test_differencing_cleans_pages_without_a_container():
    a, b = (H.page_lines(f"<body><div>Home</div><p>own {k}</p><p>Legal</p></body>") for k in (1, 2))
    assert H.main_text(a, b) == "own 1" and H.main_text([], b) == ""


def _page(*own):
    return "<nav>n%d</nav><article>%s<p>Share this</p></article><div>by %d</div><div>Legal</div>" % (
        len(own[0]), "".join(f"<p>{x}</p>" for x in own), len(own[0]))


def test_pairs_mark_lines_of_a_container_and_delete_those_outside():
    a, b, copy = (H.page_lines(_page(*x)) for x in (("first own line",), ("another line of the page",), ("first own line", "one more")))
    keep, votes = H.kept_lines(a, b)
    assert [x for x, _ in keep] == ["first own line", "Share this", "by 14"] and votes
    marks = frozenset(m for _, m in keep if m is not None)
    assert len(marks) == 1 and H.main_text(a, b, marks) == "first own line by 14"
    assert not H.kept_lines(a, copy)[1]  # the same article does not vote
    assert H.main_text(a, None) == H.main_text(a, copy) == "first own line Share this"
    other_place = H.page_lines("<article><div><p>x</p></div><ul><li>Share this</li></ul></article>")
    assert marks.isdisjoint(m for _, m in H.kept_lines(other_place, a)[0])


def test_a_host_decides_which_marked_lines_are_template(spark):
    """A footer line in every article goes, a paragraph that two neighbours carry stays."""
    pages = [(k, f"https://a.example/s/{k:02d}", _page(f"own words of page {k}", "told twice" if k in (4, 5) else f"only {k}"))
             for k in range(8)]
    pages += [(20 + k, f"https://b.example/{k}", _page(f"words {k}")) for k in range(2)]  # too few pages to tell
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS lines")
    got = {r.page_id: r.text for r in H.extract(df, "page_id", "url", "html").collect()}
    assert all("Share this" not in got[k] and f"own words of page {k}" in got[k] for k in range(8))
    assert "told twice" in got[4] and "told twice" in got[5]
    assert all("Share this" in got[20 + k] for k in range(2))


@pytest.mark.parametrize("source, want", [
    ('<div class="content no-sidebar"><article><p>a b</p></article></div>', "a b"),
    ('<article class="post share-enabled"><p>a b</p></article>', "a b"),
    ('<div class="sidebar"><main><p>a</p></main></div><p>b</p>', "a"),
    ('<article><p>use <span id="search">find</span> now</p></article>', "use find now"),
    ('<article><p>a</p><div class="site-footer">f</div><div class="shares">s</div></article>', "a s"),
    ('<article><p>a</p></article><div class="comments"><article>me too</article></div>', "a"),
    ('<article><p>a</p></article><article class="related"><p>b</p></article>', "a"),
    ('<nav><main><p>a</p></main></nav>', ""),
])
def test_class_words_never_hide_the_article(source, want):
    assert H.main_text(H.page_lines(source), None) == want


def test_every_article_of_the_given_pages_is_whole(spark):
    """Held against a reader of its own: the standard library's parser, elements by name only."""
    from html.parser import HTMLParser

    from normlens.llm.queries import QUERIES

    class Article(HTMLParser):
        gone = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "button"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.out = 0, [], []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            elif self.inside and (tag in self.gone or dict(attrs).get("class") in ("ad", "comments", "notice")):
                self.skip.append(tag)
            elif tag in ("p", "br", "h1", "h2", "h3", "li", "ul", "div", "pre", "blockquote", "td", "tr", "table"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside -= 1
            elif self.skip and self.skip[-1] == tag:
                self.skip.pop()
            elif tag in ("p", "h1", "h2", "h3", "li", "div", "pre", "blockquote", "td"):
                self.out.append(" ")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.out.append(data)

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages) > 200
    for p in pages:
        reader = Article()
        reader.feed(p.html or "")
        want = " ".join("".join(reader.out).split())
        assert got[p.page_id].text == want, p.page_id
        assert got[p.page_id].n_chars == len(want)


def test_pages_without_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "https://h/a", "<p>x</p>"), (2**60 + 1, "https://h/b", None), (3, None, "")],
                               "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in H.extract(df, "page_id", "url", "html").collect()} == {
        None: ("x", 1), 2**60 + 1: ("", 0), 3: ("", 0)}
    assert H.extract(df.limit(0), "page_id", "url", "html").collect() == []


def test_ranges_do_not_part_neighbours(spark):
    """One host in many ranges gives the texts of a plain pass in path order."""
    r = random.Random(5)
    pages = []
    for k in range(300):
        host, section = ("hot.example", r.randrange(40)) if k % 3 else (f"h{k % 7}.example", r.randrange(3))
        pages.append((k, f"https://{host}/s{section}/{r.randrange(10**6)}",
                      f"<body><div>Section {section} of {host}</div><p>own {k}</p></body>"))
    pages += [(300, None, "<p>x</p>"), (301, "https://hot.example/s1/1", None), (302, pages[1][1], "<p>own 302</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    run = lambda n: {p.page_id: p.text for p in H.extract(df, "page_id", "url", "html", ranges=n).collect()}
    parts = lambda u: tuple((u or "https:///").split("://")[1].split("/", 1))
    ordered = sorted((parts(u), i, H.page_lines(h or "")) for i, u, h in pages)
    want = {}
    for k, ((host, path), i, lines) in enumerate(ordered):
        near = [(len(H.commonprefix((path, ordered[j][0][1]))), k - j, ordered[j][2])
                for j in (k - 1, k + 1) if 0 <= j < len(ordered) and ordered[j][0][0] == host]
        want[i] = H.main_text(lines, max(near, key=lambda x: x[:2])[2] if near else None)
    assert run(1) == run(4) == run(37) == want
    assert df.count() == len(want)


def test_common_subsequence_is_longest():
    assert H.shared_lines(list("abcxd"), list("axbcd")) in ({0, 1, 2, 4}, {0, 3, 4})
    assert len(H.shared_lines(list("abcxd"), list("axbcd"))) == 4


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "u", "x" * 200), (2, "u", "x" * 200), (9, None, "x" * 200), (1, "u", "s"), (3, "u", "s"), (4, "u", None), (6, "u", "é" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write_warc(df, str(tmp_path / "w"), "page_id", "url", "html", roll_bytes=400)
    out = {r.id: r for r in W.resolve_revisits(W.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in out.items()} == {
        2: ("response", None, 200), 5: ("revisit", 2, 200), 9: ("revisit", 2, 200), 1: ("response", None, 1),
        3: ("response", None, 1), 4: ("response", None, 0), 6: ("response", None, 100)}
    assert bytes(out[6].payload).decode() == "é" * 50


def _warc_rows(spark):
    rows = [(i, f"u{i}", "same body of a page " * 9 if i % 3 else f"page {i} " * (i * 40)) for i in range(30)] + [(None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'x' AS payload")


def test_warc_payloads_come_back_whole(spark):
    folder = scratch_path(spark, "warc")
    df = _warc_rows(spark)
    W.write_warc(df, folder, "page_id", "url", "html", roll_bytes=500)
    got = {r.id: (r.record_type, r.payload) for r in W.read_warc(spark, folder).collect()}
    first = {}
    for r in sorted(df.collect(), key=lambda r: r.page_id or -1):
        body = (r.html or "").encode()
        copy = len(body) >= 100 and body in first
        first.setdefault(body, r.page_id)
        assert got[r.page_id][0] == ("revisit" if copy else "response")
        assert (bytes(got[r.page_id][1]) if not copy else body) == body
    assert W.read_warc(spark, folder, with_payload=False).count() == 31


def test_warc_files_must_be_those_of_the_manifest(spark):
    folder = scratch_path(spark, "warc")
    manifest = W.write_warc(_warc_rows(spark), folder, "page_id", "url", "html", roll_bytes=500)
    names = sorted(r.file for r in manifest.collect())
    path = os.path.join(folder.removeprefix("file:"), "data", names[0])
    extra = os.path.join(folder.removeprefix("file:"), "data", "part-left-by-a-lost-task.warc.gz")
    whole = open(path, "rb").read()
    open(extra, "wb").write(whole)  # not listed: no part of the archive
    assert W.read_warc(spark, folder).count() == 31
    for broken in (whole[:-1], whole + whole, whole[:20] + bytes([whole[20] ^ 1]) + whole[21:]):
        open(path, "wb").write(broken)
        with pytest.raises(Exception, match="not the file of the manifest"):
            W.read_warc(spark, folder).count()


def test_warc_writer_meets_the_file_of_an_earlier_attempt(spark):
    folder = "file://" + scratch_path(spark, "warc").removeprefix("file:") + "/data"
    done = []
    for _ in range(2):
        roller = W._Roller(folder, 1 << 20)
        roller.add(1, W._record(1, "u", b"x" * 200, "d" * 64, None, "2000-01-01T00:00:00Z"))
        roller.close()
        done += roller.done
    assert done[0] == done[1]
