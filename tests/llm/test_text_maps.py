"""Operators that map one text or page at a time, against the public libraries or plain models."""

import hashlib
import re

import pytest

from rasterloom.llm import bpe, html_extract, license_scan, token_counts
from rasterloom.llm.pieces import PATTERN, pieces, read_ranks, vocabulary

ODD = [
    None, "", " ", "a", "a" * 3000, "  x\n\n y 's'start don't ''s 'll've", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "　 a\x1c b\x85c", "😀" * 50, " " * 500 + "a", "é" * 1501, "1234 5.67\t\r\n", "it'S we'RE we're'd", "0", "x'", "\x00b",
]
DOCS = "doc_id long, text string, n_tokens string, spans int, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i, None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [(None, "null id", None, None, None), (1, "", "again", 1, "en"), (1, "", "again", 1, "en")], DOCS)


def test_pieces_are_those_of_the_pattern():
    import regex

    for text in ODD:
        assert pieces(text or "") == regex.findall(PATTERN, text or "")


def test_bpe_is_that_of_the_library(docs):
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    found = bpe.digests(docs, path).collect()
    want = sorted(
        (str(r.doc_id), len(ids := library.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()
    )
    assert sorted((str(r[0]), *r[1:]) for r in found) == want
    coded = bpe.encode(docs, path)
    back = coded.withColumn("back", bpe.decode(coded.token_ids, docs.sparkSession, path))
    assert all(bytes(r.back).decode() == (r.text or "") for r in back.collect())


def test_perfect_hash_is_minimal_and_exact():
    entries = {f"key {i}".encode(): i for i in range(2000)}
    found = bpe.PerfectHash(entries)
    assert len(found.keys) == len(entries)
    assert all(found.find(k) == v for k, v in entries.items())
    assert found.find(b"other") is None and bpe.PerfectHash({}).find(b"") is None


def test_long_texts_are_encoded_in_parts():
    import tiktoken

    ranks = read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Words and  more\n\n words 123 don't. " * 20_000
    assert bpe.Encoder(ranks).encode(text).tolist() == library.encode_ordinary(text)


def test_token_counts_are_those_of_the_library(docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    found = token_counts.token_counts(docs, path, limit=40).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := count(r.text), n > 40) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in found) == want
    own = token_counts.Transducer(path, most=50)  # forgets its states again and again
    text = "The transducers' states, compiled when met; it's 42 más ñandú " * 40
    assert own.count(text, size=64) == count(text)
    assert own.count("x" * 500, size=64) == count("x" * 500)


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), places


def test_license_base_is_brute_force(spark, tmp_path):
    texts = ODD + [
        "Released under the MIT License. UNDER THE MIT LICENSE", "Apache License, Version 2.0; apache license version 20", "CC BY-NC 4.0 cc by ncx",
        "under the under the mit license", "under_the mit-license", "xunder the mit license", "é under the mit license",
    ]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in license_scan.op4_license_scan(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        n, places = brute_licenses(text)
        r = rows[i]
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_with_edits():
    spans = license_scan.Scanner().ready().spans
    found = lambda text: [(s.label, s.first_word, s.edits) for s in spans(license_scan.normalise(text))]
    assert found("it is under the MIT licence") == [("mit", 2, 1)]
    assert found("Apache Licence, Version 2.0") == [("apache-2", 0, 1)]
    assert found("Apache License, Version 1.1") == []
    assert found("cc by nd") == []
    assert found("GNU Genral Public Lisense") == [("gpl", 0, 2)]
    assert found("") == found("mit") == []


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><div id="cookie-notice">cookies</div>
<article><h1>Head &amp; tail</h1><p><b>One   two
three.<br><p>Four&nbsp;five.</p><p>Six</article><div class="comments"><p>first!</p></div><aside>side</aside><form><p>mail</p></form>
<footer>&copy; foot</footer></body></html>"""


def test_pages(spark):
    want = "Head & tail\nOne two three.\nFour five.\nSix"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>just text", None), (4, "u", "<article></article>", None)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r.page_id: r.text for r in found} == {1: want, 2: "", None: "", 3: "just text", 4: ""}
    assert all(r.n_chars == len(r.text) for r in found)


def test_pages_without_an_article_element():
    body = "".join(f"<p>{'sentence after sentence ' * 8}{i}.</p>" for i in range(5))
    page = f"<body><div class='menu'><a>x</a></div><ul><li><a>one</a></li><li><a>two</a></li></ul><h2>Title</h2>{body}<footer>f</footer></body>"
    text = html_extract.main_text(page)
    assert text.startswith("Title\nsentence") and text.count("\n") == 5 and "one" not in text
    assert html_extract.main_text(f"<main><h1>T</h1>{body}</main>").count("\n") == 5


def test_pages_of_the_tables():
    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        import html as h

        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert html_extract.main_text(html).split("\n") == [w for w in want if w]


def test_pages_keep_all_of_the_article():
    text = html_extract.main_text
    body = "".join(f"<p>{'sentence after sentence ' * 8}{i}.</p>" for i in range(5))
    inner = text(f"<body><article><h1>Title</h1><div class='entry-content'>{body}</div><p>closing</p></article></body>").split("\n")
    assert (inner[0], inner[-1], len(inner)) == ("Title", "closing", 7)
    headed = text(f"<body><h1 class='entry-title'>Title</h1><div>{body}</div></body>").split("\n")
    assert headed[0] == "Title" and len(headed) == 6
    # the named container holds a byline, the text stands elsewhere
    assert text(f"<body><div class='post-meta'>By A.</div><div>{body}</div></body>").split("\n")[0] == "By A."
    plain = text(f"<body><p>By A.</p><p>Monday</p>{body}<p>Short end.</p><p>More.</p><p>Bye.</p><p>End.</p></body>").split("\n")
    assert plain[:2] == ["By A.", "Monday"] and plain[-1] == "End." and len(plain) == 11
    # a long text beside the article is no reason to leave the article
    assert text(f"<body><article><h1>T</h1>{body}</article><div>{'imprint ' * 30}</div></body>").count("\n") == 5
    assert text(f"<body><div class='post-head'><h1>T</h1></div><div class='post-body'>{body}</div></body>").startswith("T\nsentence")


def test_smoothed_clusters_decide_what_stays(monkeypatch):
    body = "".join(f"<p>{'sentence after sentence ' * 8}{i}.</p>" for i in range(3))
    links = "<ul><li><a>Home</a></li><li><a>About</a></li><li><a>News</a></li><li><a>x</a></li></ul>"
    page = f"<body>{links}<h1>Title</h1>{body}<p><a>Jane Doe</a></p>{body}</body>"
    lines = html_extract.main_text(page).split("\n")
    assert lines[4] == "Jane Doe" and lines[0] == "Title" and len(lines) == 8
    monkeypatch.setattr(html_extract, "smooth", lambda values: values)
    assert "Jane Doe" not in html_extract.main_text(page)


def test_an_inexact_notice_before_an_exact_one():
    spans = license_scan.Scanner().ready().spans
    exact, inexact = "under the mit license", ("under the mit licence", "under the mit lisence", "undr the mit license")
    import random

    rng = random.Random(4)
    for _ in range(40):
        parts = [rng.choice((exact, *inexact)) for _ in range(rng.randint(2, 6))]
        want = [(4 * i, 0 if part == exact else spans(license_scan.normalise(part))[0].edits) for i, part in enumerate(parts)]
        assert sorted((s.first_word, s.edits) for s in spans(license_scan.normalise(" ".join(parts)))) == want


def test_names_do_not_empty_an_article():
    text = html_extract.main_text
    body = "".join(f"<p>{'sentence after sentence ' * 8}{i}.</p>" for i in range(5))
    for page in (
        f"<article class='post'><div class='entry social-science'>{body}</div></article>",
        f"<body><div class='page search'><article>{body}</article></div></body>",
        f"<body><div class='main-content with-sidebar'>{body}</div></body>",
        f"<body><div class='site-footer'>x y z</div><article>{body}<div class='comment-list'>nice one</div></article><div class='ad-slot'>buy</div></body>",
    ):
        assert text(page).count("\n") == 4 and text(page).startswith("sentence"), page
    assert text("<article><h1>T</h1><p class='ad'>buy<p>Real text one.<p>Real two.</article>") == "T\nReal text one.\nReal two."
    assert text("<article><ul><li class='ad'>buy<li>One<ul><li>In</ul><li>Two</ul><dl><dt>A<dd>B<dt>C</dl><table><tr><td>1<td>2<tr><td>3</table></article>").split("\n") == "One In Two A B C 1 2 3".split()
    # comments that are articles of their own don't displace the article, nor do they come with it
    assert "Me too" not in text(f"<body><article>{body}</article><section class='comments'><article>Me too {body}</article></section></body>")


def test_unclosed_elements_take_linear_time():
    import time

    began = time.time()
    assert html_extract.main_text("<body><article>" + "<b>x" * 100_000 + "<p>y" * 50_000 + "</i>" * 50_000).endswith("y")
    assert html_extract.main_text("<ul>" + "<b>" * 50_000 + "<li>x</li>" * 50_000)
    assert time.time() - began < 60


def test_pages_on_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")
    assert html_extract.extract(empty).count() == 0
    rows = [(1, None, "<p>a</p>", "clash", 5)] * 2 + [(None, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>", "clash", 5)]
    found = html_extract.extract(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted(r.n_chars for r in found) == [1, 1, 99_999]


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_licenses_are_those_of_a_plain_edit_distance():
    """Every run of whole words within the allowed edits of a notice is found, or a better one that overlaps it."""
    import random

    rng, letters = random.Random(6), "abcdefgilmnoprstu "
    scanner = license_scan.Scanner().ready()
    for _ in range(60):
        words = []
        for _ in range(4):
            phrase = rng.choice(list(license_scan.NOTICES))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(phrase))
                phrase = phrase[:at] + rng.choice(["", rng.choice(letters), phrase[at] + rng.choice(letters)]) + phrase[at + 1 :]
            words += phrase.split() + rng.choices(["and", "the", "of", "license", "x"], k=rng.randint(0, 3))
        text = license_scan.normalise(" ".join(words))
        words = text.split(b" ")
        found = scanner.spans(text)
        for phrase, label, k in scanner.notices:
            digits = [c for c in phrase if 48 <= c <= 57]
            n = phrase.count(b" ") + 1
            mine = [s for s in found if s.label == label]
            for first in range(len(words)):
                for size in range(max(1, n - k), n + k + 1):
                    run = b" ".join(words[first : first + size])
                    if first + size <= len(words) and (e := edit_distance(phrase, run)) <= k and not digits:
                        assert any(s.first_word < first + size and first < s.first_word + s.n_words and s.edits <= e for s in mine), (text, phrase, run)
            for s in mine:
                assert edit_distance(phrase, b" ".join(words[s.first_word : s.first_word + s.n_words])) <= k


def test_licenses_on_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string, n_words long")
    assert license_scan.scan(empty).count() == 0
    rows = [(None, "cc by nc", "clash", 1), (1, "cc by nc", "clash", 1), (1, "cc by nc", "clash", 1), (2, None, None, None), (3, "word " * 300_000 + "cc by nc", "clash", 1)]
    found = license_scan.scan(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted((r.n_words, len(r.spans)) for r in found) == [(0, 0), (3, 1), (3, 1), (3, 1), (300_003, 1)]


def test_elements_within_a_line_and_open_comments():
    text = html_extract.main_text
    page = lambda body: f"<html><body><article><h1>Title of it</h1>{body}<p>The last words stand here, and some more of them.</p></article></body></html>"
    lines = lambda body: text(page(body)).split("\n")[1:-1]
    assert lines("<p>hidden <span hidden>no</span> yes</p>") == ["hidden yes"]
    assert lines("<p>one <span class=ad>buy</span>two <button>press</button> three</p>") == ["one two three"]
    assert lines("<p>a<script>var x;</script>b <svg><title>t</title></svg>c</p>") == ["ab c"]
    assert lines("<p>before</p><span class='sidebar'><div>no</div></span><p>after</p>") == ["before", "after"]
    assert lines("<p>x</p><select><option>1<option>2</select> and on <p>y</p>") == ["x", "and on", "y"]
    assert text("<article><p>a<!-- unclosed <p>b</p>") == "a"
    assert text("<article><p>a<!-- closed --> b</p></article>") == "a b"


def test_lists_of_other_articles_and_feet_stay_out():
    text = html_extract.main_text
    body = "<p>" + "A sentence of the article, and one more of it. " * 8 + "</p>"
    for other in ("<div class='article-list'><a href=x>other</a></div>", "<div id='foot'>Copyright 2020</div>", "<div class='post-teasers'><p>Read this next one</p></div>", "<p class=copyright>Copyright 2020</p>"):
        assert "\n" not in text(f"<html><body><main>{body}</main>{other}</body></html>")
        assert text(f"<html><body><main>{body}</main>{other}</body></html>").startswith("A sentence")


def test_many_inexact_notices_take_linear_time():
    import time

    spans = license_scan.Scanner().ready().spans
    took = {}
    for n in (400, 1600):
        words = license_scan.normalise("under the mit licence and " * n)
        began = time.process_time()
        assert len(spans(words)) == n
        took[n] = time.process_time() - began
    assert took[1600] < 9 * took[400]  # sixteen times, were it quadratic
