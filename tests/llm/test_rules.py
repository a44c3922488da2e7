"""Quality rules, personal data and pages."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidmill.llm import html_extract as H
from evidmill.llm import pii, quality_rules

WS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "a b c a b c", "x y\nx y\n\nz #*$", "AB CD!! ef", "w " * 3000, "é\xa0è 中 <a|b>", "one two three one two three four", "\n".join(f"line {k}" for k in range(400))]


def fuzz():
    rng = random.Random(2)
    return ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "A", "\x0b"]) for _ in range(rng.randrange(150))) for _ in range(80)]


def slow(t):
    t = t or ""
    w = WS.findall(t)
    lines = [x for x in t.split("\n") if WS.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit)


def test_measurements_by_brute_force(spark):
    texts = TEXTS + fuzz()
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality_rules.ledger(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow(t), t
        assert bool(r["fail_bits"] & 1) == (r["n_words"] < 50)
        assert bool(r["fail_bits"] & 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(None, t) for t in TEXTS], "doc_id long, text string")
    book = quality_rules.ledger(df)
    bits = [r["fail_bits"] for r in book.collect()]
    for version, mask in quality_rules.POLICIES.items():
        assert book.where(quality_rules.passes(version)).count() == sum(not b & mask for b in bits)
    for r in quality_rules.ablations(book, "v2").collect():
        b, mask = quality_rules.BIT[r["rule"]], quality_rules.POLICIES["v2"]
        assert (r["n_failed"], r["n_only"]) == (sum(bool(x & b) for x in bits), sum(x & mask == b for x in bits))
        assert r["n_kept_without"] == sum(not x & mask & ~b for x in bits)
    none = quality_rules.ablations(quality_rules.ledger(df.limit(0)), "v1").collect()
    assert all(r["n_failed"] == 0 for r in none)


PII = [
    None,
    "",
    "write to a.b@x-y.co.uk, or a@b or c@d.e_f@g.h",
    "host 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5 and 0001.2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 79927398713",
    "+1 (555) 123-4567 and +12 3 and + 1 and +1234567890123456",
    "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000 or GB82WEST12345698765433",
    "my social security number 123-45-6789, part 123-45-6789",
    "é中 a@b.cd 😀 1.2.3.4",
    "9" * 4000 + "a" * 4000 + "@" + "1 " * 4000,
]
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_spans_by_brute_force(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice(["1", "2", "9", ".", "@", "a", "+", " ", "-", "(", ")", "b.c"]) for _ in range(60)) for _ in range(300)]
    texts = PII + more
    got = {r["k"]: r["pii"] for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()}
    for k, t in enumerate(texts):
        assert [(x["kind"], x["start"], x["end"]) for x in got[k] if x["kind"] in pii.BASE] == slow_spans(t), t
    assert [(x["kind"], PII[6][x["start"] : x["end"]]) for x in got[6] if x["kind"] == "iban"] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    # the second number has no context word of its own, but the first one's is near enough
    assert [x["score"] for x in got[7] if x["kind"] == "ssn"] == [0.7, 0.7]


def test_redaction(spark):
    df = pii.spans(spark.createDataFrame([(t,) for t in PII], "text string"))
    for r in df.select("text", "pii", pii.redacted(F.col("text"), F.col("pii")).alias("out")).collect():
        if r["text"] is None:
            assert r["out"] is None
            continue
        at, want = 0, ""
        for s, e, k in sorted((x["start"], x["end"], x["kind"]) for x in r["pii"]):
            if s >= at:
                want += r["text"][at:s] + f"<{k.upper()}>"
            at = max(at, e)
        assert r["out"] == want + r["text"][at:]


def test_many_spans_in_one_long_text(spark):
    """Time grows little faster than the spans; places, scores and redaction hold beyond one chunk."""
    one = "é card 4111 1111 1111 1111, a@b.cd 1.2.3.4 "
    t = one * 33_000
    df = pii.spans(spark.createDataFrame([(1, t), (2, "1." * 300_000), (3, "x" * 5000 + " 1.2.3.4")], "k int, text string"))
    got = {r["k"]: r for r in df.select("k", "pii", pii.redacted(F.col("text"), F.col("pii")).alias("out")).collect()}
    places = [(x["kind"], x["start"], x["end"]) for x in got[1]["pii"]]
    assert places == slow_spans(t) and len(places) > 98_000
    assert got[1]["out"] == "é card <CARD>, <EMAIL> <IP> " * 33_000
    assert [(x["kind"], x["start"], x["end"]) for x in got[2]["pii"]] == [("ip", s, s + 7) for s in range(0, 599_993, 8)]
    assert got[3]["out"] == "x" * 5000 + " <IP>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>m</nav><article><h1>T</h1><p>a  b\nc<p>d <b>e<br>f</article><footer>z</footer>", "T\na b c\nd e f"),
        ("<main><div class='ad'>x</div><p>y</p><form>q</form><aside>s</aside></main><p>out</p>", "y"),
        ("<body><header>H</header><div>one<div>two</div>three</div><script>a<b</script></body>", "one\ntwo\nthree"),
        ("<article><p>k</p><section id=comments><p>c</p></section></article>", "k"),
        ("<article><ul><li>1<li>2 &lt;</ul><table><tr><td>a<td>b</table><!-- x --></article>", "1\n2 <\na\nb"),
        ("<p>unclosed <b>bold <i>both</p><p title='a>b'>next &#233;&nbsp;x</p>", "unclosed bold both\nnext é x"),
        ("<div role=dialog>d</div><p hidden>h</p><p style='display:none'>n</p><p>v</p>", "v"),
        ("<p>" * 3000 + "deep" + "<div>" * 3000, "deep"),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page, set()) == text


def test_templates_go_and_articles_stay(spark):
    page = lambda k: f"<div class=bar>same bar</div><div><p>text {k}</p></div>"
    art = lambda k: "<div class=bar>same bar</div><article><p>copied everywhere</p></article>"
    rows = [(k, f"https://u@www.h.org:80/{k}", page(k)) for k in range(8)] + [(k, f"//g.org/{k}", art(k)) for k in range(10, 18)] + [(20, None, None), (21, "x", "<p>lone"), (0, "https://h.org/0", page(0))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in H.extract_main_text(df).collect())
    want = Counter([(k, f"text {k}", 6) for k in range(8)] + [(0, "text 0", 6)] + [(k, "copied everywhere", 17) for k in range(10, 18)] + [(20, "", 0), (21, "lone", 4)])
    assert got == want
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_boxes_inside_articles_go_and_copied_articles_stay(spark):
    box = "<div class=b7><p>Get our letter every week.</p></div>"
    body = "<h2>Summary</h2>" + "".join(f"<p>A sentence number {k} of the wire story.</p>" for k in range(6))
    own = lambda k: f"<article><h2>Summary</h2><p>This is what page {k} alone has to say.</p>{box}</article>"
    copy = lambda k: f"<article><p>Printed on day {k}</p>{body}</article>"
    bare = lambda k: f"<div><p>Day {k}</p>{body}</div>"
    rows = [(k, "http://a.org/", own(k)) for k in range(8)] + [(k, "http://b.org/", copy(k)) for k in range(10, 18)] + [(k, "http://c.org/", bare(k)) for k in range(20, 28)]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = "\n".join(["Summary"] + [f"A sentence number {k} of the wire story." for k in range(6)])
    assert all(got[k] == f"Summary\nThis is what page {k} alone has to say." for k in range(8))
    assert all(got[k] == f"Printed on day {k}\n{story}" for k in range(10, 18))
    assert all(got[k] == f"Day {k}\n{story}" for k in range(20, 28))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post category-social'><p>body</p></article>", "body"),
        ("<div class='content with-sidebar'><article><p>body</p></article></div>", "body"),
        ("<main><h1>Head</h1><p>the body of the page</p><article>teaser</article></main>", "Head\nthe body of the page\nteaser"),
        ("<article><p>the whole story</p></article><div class=related><article>other</article></div>", "the whole story"),
        ("<div>" * 3000 + "<nav>menu</nav><p>deep</p>", "deep"),
    ],
)
def test_main_text_is_not_lost(page, text):
    assert H.main_text(page, set()) == text


def test_quotes_open_values_only_and_broken_pages_take_linear_time(spark):
    import time

    pages = {
        1: ("<article><p class=x'>Hello world</p><p>it's fine</p></article>", "Hello world\nit's fine"),
        2: ("<p don't>Hello</p><p>it's there</p>", "Hello\nit's there"),
        3: ("<!--><p>one</p><!---><p>two</p><!-- > <p>no</p> --><p>three</p><!-- x --!><p>four</p>", "one\ntwo\nthree\nfour"),
        4: ("<p title=\"a > b\" data-x = 'c > d'>text</p>", "text"),
        5: ('<p title="open>first</p><p>second</p>', "first\nsecond"),
        6: ("<p>before</p><!-- never closed <p>no</p>", "before"),
    }
    df = spark.createDataFrame([(k, "http://h/", h) for k, (h, _) in pages.items()], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()} == {k: t for k, (_, t) in pages.items()}
    for part in ('<p "', "<a ", "<a x='", '<a x="', "<!x ", "<a x=", '<p ="y', "<!", "<p x='>", "</a "):
        for tail in ("", ">", "'>", '">'):
            t = time.time()
            H.parse(part * (1_000_000 // len(part)) + tail)
            assert time.time() - t < 20, (part, tail)
