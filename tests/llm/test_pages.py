import base64
import hashlib
import html
import io
import re

import pytest
from llm_cases import by_row

from stayline.llm import html_content, warc

PAGES = [
    (1, "http://a", "<p>same</p>", 1), (2, None, "<p>same</p>", 1), (3, "http://c d", "", 1), (4, "http://e", None, 1),
    (5, "u", "<article>" + "<p>long text here</p>" * 20_000 + "</article>", 1), (None, "n", "<p>same</p>", 1),
    (6, "u", "<p>é</p>", 1), (6, "u", "<p>é</p>", 1), (7, "u", "<p>é</p>", 1),
]
SCHEMA = "page_id long, url string, html string, payload_bytes int"


@pytest.fixture(scope="module")
def pages(session):
    return session.createDataFrame(PAGES, SCHEMA)


@pytest.fixture(scope="module")
def table(session):
    return session.read.parquet("/root/testdata/sf0.001/pages.parquet")


def wanted(rows):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, u, h, *_ in rows:
        raw = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = i is not None and first[h or ""] < i
        yield i, len(raw), sha, "revisit" if again else "response", first[h or ""] if again else None


def test_archives(pages, table):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for df in (pages, table):
        rows = [tuple(r) for r in df.collect()]
        manifest = warc.write_archives(df)
        assert by_row(warc.read_archives(manifest), *names) == {k: [*wanted(rows)].count(k) for k in wanted(rows)}
        payloads = {bytes(r.payload) for r in warc.read_archives(manifest, with_payload=True).collect() if r.payload is not None}
        assert payloads == {(r[2] or "").encode() for r in rows}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_small_payloads_are_not_revisited(pages):
    got = warc.read_archives(warc.write_archives(pages, least_bytes=100))
    assert got.where("record_type = 'revisit'").count() == 0


def archive(pages):
    return b"".join(warc.archive_frames([warc.record_bytes(p, "2024-01-01T00:00:00Z") for p in pages]))


def page(i, payload=b"x" * 50):
    return warc.Page(i, f"http://{i}", payload, len(payload), warc.digest(payload), "response", None)


def test_records_are_checked():
    whole = archive([page(i) for i in range(30)])
    assert [warc.parsed_record(r).page_id for r in warc.archive_records(io.BytesIO(whole))] == list(range(30))
    for broken in (whole[4:], whole[:-3], whole[:6]):
        with pytest.raises((warc.ArchiveError, Exception)):
            list(warc.archive_records(io.BytesIO(broken)))
    record = warc.record_bytes(page(1), "d")
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"xx", b"xy"), (b"WARC-Date: d\r\n", b""), (b"Content-Length: ", b"Content-Length: 9"),
                     (b"WARC-Type: response", b"WARC-Type: other"), (b"sha1:", b"md5:")):
        with pytest.raises(warc.ArchiveError):
            warc.parsed_record(record.replace(old, new, 1))
    with pytest.raises(warc.ArchiveError):
        warc.parsed_record(record + b"\r\n")
    assert list(warc.archive_frames([])) == []


def test_extraction_of_the_pages(table):
    got = {r.page_id: (r.text, r.n_chars) for r in html_content.extracted(table).collect()}
    for r in table.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:h1|p|br)>", article)]
        text = " ".join(b for b in blocks if b)
        assert got[r.page_id] == (text, len(text))


def test_extraction_edges(pages):
    got = html_content.extracted(pages)
    rows = {r.page_id: r for r in got.collect()}
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(PAGES)
    assert rows[3].text == rows[4].text == "" and rows[3].n_chars == 0
    assert rows[5].n_chars == 20_000 * 15 - 1 and rows[None].text == "same"
    assert html_content.extracted(pages.limit(0)).count() == 0


BODY = (
    "<h2>Title of it</h2><p>This is a long paragraph of the text with <a href=x>a link</a>, more&nbsp;text &amp; so on and on.</p>"
    "<p>Be.</p><p>Another paragraph that goes on for a while, so that it reads like a text.<br>Next line.</p>"
)
TEXT = (
    "Title of it This is a long paragraph of the text with a link, more text & so on and on. Be. "
    "Another paragraph that goes on for a while, so that it reads like a text. Next line."
)
FURNITURE = [
    "<header><h1>Site</h1></header>", "<nav><a>Home</a></nav>", "<div class='cookie-notice'>We use cookies, and a long text tells you about it here.</div>",
    "<aside>Side</aside>", "<div id=sidebar><p>Much text that stands beside the article and is not part of it at all.</p></div>",
    "<form><label>Name</label><input><textarea>x</textarea></form>", "<div class='ad'>Buy this now</div>", "<script>var a='<p>';</script>",
    "<style>p{}</style>", "<section class='comments'><p>I am a reader with a long comment on this text, thank you for it.</p></section>",
    "<div role=navigation>Go</div>", "<div style='display:none'>hidden</div>", "<noscript>Turn it on</noscript>", "<!-- note -->", "<footer>End</footer>",
]


@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div class=has-sidebar><div>{}</div></div>"])
def test_furniture_goes(inside):
    half = len(FURNITURE) // 2
    for close in ("</body></html>", ""):
        raw = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(FURNITURE[:half]) + inside.format(BODY) + "".join(FURNITURE[half:]) + close
        assert html_content.main_text(raw) == TEXT


def test_furniture_inside_an_article_goes():
    raw = "<article><header><h1>Head</h1></header>" + BODY + "".join(FURNITURE[1:]) + "</article>"
    assert html_content.main_text(raw) == "Head " + TEXT


SLUGS = [
    ("<h2 id='social-history'>{}</h2>"), ("<h2 class='related' id='comments'>{}</h2>"), ("<section id='related-work'><p>{}</p></section>"),
    ("<pre><code>x <span class='hljs-comment'>{}</span></code></pre>"), ("<pre><span class='token comment'>{}</span></pre>"),
    ("<div class='ad-hoc-networks'>{}</div>"), ("<p id='share-prices'>{}</p>"), ("<div class='header'>{}</div>"), ("<section id='navigation'>{}</section>"),
]
MORE_FURNITURE = [
    "<div class='social-share'>Share</div>", "<div class='post sidebar-left'>Beside</div>", "<ul class='related-posts'><li>Other</ul>", "<div class='AdBox'>Buy</div>",
]


@pytest.mark.parametrize("slug", SLUGS)
def test_slugs_and_words_inside_names_are_content(slug):
    raw = "<article>" + BODY + slug.format("Own words") + "".join(FURNITURE[1:] + MORE_FURNITURE) + "<p>End.</p></article>"
    assert html_content.main_text(raw) == TEXT + (" x" if "<code>" in slug else "") + " Own words End."


def test_without_an_article_all_lines_of_the_container_stay():
    import random

    rng = random.Random(6)

    def words(chars):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(max(1, chars // 10)))

    for _ in range(60):
        sizes = [400] * 5 + [10] * rng.randint(1, 40) + rng.choices([10, 30, 400], k=rng.randint(0, 9))
        wanted, parts = [], []
        for size in sizes:
            text = words(size)
            wanted.append(text)
            parts.append(rng.choice(["<div>{}</div>", "<p>{}</p>", "<div><div>{}</div></div>", "<section id=related-work><p>{}</section>", "<ul><li>{}</ul>"]).format(text))
            if rng.random() < 0.2:
                parts.append(rng.choice(FURNITURE + MORE_FURNITURE))
        parts[0] = f"<div>{wanted[0]}</div>"
        body = "".join(parts)
        for page in (body, f"<div class=page><div>{body}</div></div>"):
            assert html_content.main_text(f"<html><body><nav>Go</nav>{page}<footer>End</footer></body></html>") == " ".join(wanted)
    deep = "<div>x" * 30_000
    assert html_content.main_text(deep).count("x") == 30_000


def test_stray_end_tags_take_no_time():
    import time

    started = time.perf_counter()
    for page in ("<div></p>" * 60_000, "<u><div>" + "<b></u>" * 60_000, "<b>" * 30_000 + "<li></li>" * 30_000, "<p><b></p>" * 30_000):
        html_content.main_text(page + "word")
    assert time.perf_counter() - started < 60  # hours where every end tag scans the open stack
    assert html_content.main_text("<p>a<b>b</p>c</b>d</u><i>e</p>") == "ab cde"


def test_odd_pages():
    assert html_content.main_text("plain text") == "plain text" and html_content.main_text("<article></article>") == ""
    assert html_content.main_text("<p>a<b>b</b>c<p>d<i>e") == "abc de"
    assert html_content.main_text("<ul><li>one<li>two</ul>") == "one two"
    assert html_content.main_text("&lt;p&gt; &#233;&eacute;") == "<p> éé"


def test_record_ids_are_unique_and_revisits_find_their_target(session):
    from pyarrow import fs

    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (None, "w", "same"), (None, "w", "same"), (3, "x", "own"), (1, "u", "other")]
    manifest = warc.write_archives(session.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    ids, refers, first = [], set(), set()
    for r in manifest.collect():
        store, path = fs.FileSystem.from_uri(r.archive)
        with store.open_input_stream(path, compression=None) as stream:
            for raw in warc.archive_records(stream):
                head = dict(line.split(": ", 1) for line in raw.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                ids.append(head["WARC-Record-ID"])
                refers |= {head["WARC-Refers-To"]} if "WARC-Refers-To" in head else set()
                if head.get("X-Page-ID") == "1" and head["WARC-Type"] == "response" and head["WARC-Payload-Digest"].endswith(warc.digest(b"same")):
                    first.add(head["WARC-Record-ID"])
    assert len(ids) == len(set(ids)) == len(rows) and len(first) == 2 and len(refers) == 1 and refers < first
