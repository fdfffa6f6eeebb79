"""Ogg media, token counts, language, main text and url filters."""

import hashlib
import random
import time
import zlib
from itertools import pairwise, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sluice.llm import htmlmain, langid, media, tokencount, urltrie
from sluice.llm.spans import Texts
from sluice.llm.wordids import WordIds

from hand_pages import PAGES

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def slow_crc(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def test_page_checksum():
    for data in (b"", b"OggS", bytes(range(256))):
        assert media.page_checksum(data) == slow_crc(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 255, 4095, 4096, 4097, 8192, 255 * 17, 300_000])
def test_ogg_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = data + bytes(-len(data) % 64 or (0 if data else 64))
    coded = media.encode(payload)
    back, feature = media.decode(coded)
    assert back == payload and f"seconds={len(payload) / media.RATE:.6f}" in feature
    streams = media.demultiplex(coded)
    assert len(streams) == media.STREAMS and all(s.ended for s in streams.values())


def test_ogg_damage_is_found():
    coded = bytearray(media.encode(bytes(20_000)))
    for at in (30, 400, len(coded) - 1):
        bad = bytes(coded[:at]) + bytes([coded[at] ^ 1]) + bytes(coded[at + 1 :])
        with pytest.raises(ValueError):
            media.decode(bad)
    with pytest.raises(ValueError):
        media.decode(bytes(coded[:-1]))


def test_lacing_and_continued_packets():
    packets = [(b"head", 0), (b"a" * 255, 255), (b"", 255), (b"b" * 70_000, 70_255), (b"c", 70_256)]
    stream = media.demultiplex(b"".join(media.stream_pages(9, packets)))[9]
    assert stream.packets == [p for p, _ in packets] and stream.pages > 2
    times = stream.timestamps(1, [0, 255, 0, 70_000, 1])
    assert times == [0.0, 255.0, 255.0, 70_255.0, 70_256.0]


def test_ogg_query(odd, odd_texts, empty):
    rows = media.ogg_read(media.ogg_store(odd), carry=("n_bytes",)).collect()
    assert len(rows) == len(odd_texts)
    for r, t in zip(rows, odd_texts, strict=True):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert rows[6][1:] == rows[7][1:]
    assert media.ogg_read(media.ogg_store(empty)).count() == 0


def test_damaged_media_are_rows(spark):
    good = media.encode(bytes(640))
    bad = bytearray(good)
    bad[-1] ^= 1
    rows = spark.createDataFrame([(1, good), (2, bytearray(bad)), (3, None), (4, good[:-3]), (5, b"")], "doc_id long, media binary")
    found = {r["doc_id"]: (r["payload_bytes"], r["media_bytes"], r["problem"] is None) for r in media.ogg_read(rows).collect()}
    assert found[1] == (640, len(good), True) and found[3] == (None, None, True)
    assert found[2] == (None, len(bad), False) and found[4][0] is None and not found[4][2]


def noise(n, seed=1):
    rng = random.Random(seed)
    letters = "aebcé ▁\t\n<>|'’sS0١中\U0001f600\x00\x1cßÀ,.!" + chr(0x301) + chr(0x3A3) + chr(0x130)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(n)]


def test_merge_counts_equal_the_library(odd_texts):
    model, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokencount.MergeCounter(PIECES)
    for t in [*odd_texts, *noise(1500), " lead", "two  spaces", "aaaa" * 500]:
        assert counter.count(t) == len(model.encode(t or "")), t
        assert counter.merged(t or "") >= 0


def test_merge_count_query(odd, odd_texts, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = tokencount.count_tokens(odd, PIECES, limit=10).collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows] == [(len((t or "").encode()), n := len(model.encode(t or "")), n > 10) for t in odd_texts]
    assert tokencount.count_tokens(empty, PIECES).count() == 0


def test_word_ids_equal_the_library(odd_texts):
    whole, own = Tokenizer.from_file(WORDS), WordIds(WORDS)
    texts = [*odd_texts, *noise(1500, 2)]
    for low in range(0, len(texts), 400):
        part = texts[low : low + 400]
        ids, counts = own.encode(Texts(pa.array(part)), 2)
        want = [[*e.ids, 2] for e in whole.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_of_held_out_documents(spark):
    docs = documents(spark)
    model = langid.train(docs.where(langid.remainder() != 2))
    rows = langid.predict(docs.where(langid.remainder() == 2), model, carry=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_scores_by_brute_force(spark):
    import math

    rows = [(1, "ab", "x"), (2, "abab", "x"), (3, "cd", "y"), (4, None, "y"), (5, "12", "y"), (6, "zz", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ("x", "y")
    grams = lambda t: [int(g) for h in langid._buckets_of(t) for g in h]
    counts = {"x": grams("ab") + grams("abab"), "y": grams("cd")}
    logp = lambda lang, g: math.log((counts[lang].count(g) + langid.SMOOTHING) / (len(counts[lang]) + langid.SMOOTHING * langid.BUCKETS))
    prior = {"x": math.log(2 / 3), "y": math.log(1 / 3)}
    for t in ("ab", "cda", "acbd"):
        total = {lang: prior[lang] + sum(logp(lang, g) for g in grams(t)) for lang in counts}
        best = max(total, key=total.get)
        (name,), (score,), (lift,) = model.score([t])
        assert lift == pytest.approx((total[best] - prior[best]) / len(grams(t)) + math.log(langid.BUCKETS), abs=1e-4)
        assert name == best and score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), abs=1e-4)


def test_language_blocks_cover_long_texts():
    text = "".join(random.Random(3).choice("abcdé ") for _ in range(3 * langid.BLOCK + 5))
    points = langid.code_points(text)
    whole = [int(x) for h in langid.buckets(points) for x in h]
    parts = [int(x) for h in langid._buckets_of(text) for x in h]
    assert sorted(whole) == sorted(parts)


def test_language_odd_rows(odd, odd_texts, empty):
    model = langid.train(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(odd_texts)
    for r, t in zip(rows, odd_texts, strict=True):
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))) and (r["lang_pred"] in ("und", "en"))
    none = langid.train(empty)
    assert none.langs == () and {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    kept = langid.known(odd, model, -100.0)
    assert kept.columns == odd.columns and kept.count() == sum(any(map(str.isalpha, t or "")) for t in odd_texts)


def test_texts_of_no_learned_language(spark):
    docs = documents(spark)
    model = langid.train(docs)
    others = spark.createDataFrame([(1, chr(0x4E2D) + chr(0x6587) * 30), (2, "".join(map(chr, range(0x410, 0x440))) * 4)], "doc_id long, text string")
    assert langid.known(others, model).count() == 0
    assert langid.known(docs, model).count() == docs.where("text rlike '\\\\p{L}'").count()


def test_many_labels(spark, monkeypatch):
    rows = [(i, "ab" * (i % 5 + 1), f"l{i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.train(df)
    monkeypatch.setattr(langid, "HELD_LANGS", 3)
    parted = langid.train(df)
    assert whole.langs == parted.langs and (whole.logp == parted.logp).all() and (whole.prior == parted.prior).all()
    monkeypatch.setattr(langid, "MAX_LANGS", 39)
    with pytest.raises(ValueError, match="40 languages"):
        langid.train(df)


def test_field_decodes_as_brute_force():
    from itertools import product

    rng = random.Random(1)
    for _ in range(30):
        emit = {f: rng.uniform(-2, 2) for f in "abcd"}
        field = htmlmain.Field(emit, (rng.uniform(-1, 1), 0.0), ((rng.uniform(-1, 1), 0.0), (0.0, rng.uniform(-1, 1))))
        page = [[rng.choice("abcd") for _ in range(2)] for _ in range(rng.randint(1, 7))]

        def score(labels, field=field, page=page, emit=emit):
            s = field.start[labels[0]] + sum(emit[f] for b, k in zip(page, labels, strict=True) if k for f in b)
            return s + sum(field.move[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(product((0, 1), repeat=len(page)), key=score)
        assert score(field.decode(page)) == pytest.approx(score(best))


def test_slope_by_enumeration():
    """The gradient of training against differences of the log-likelihood, summed over all labellings of small pages."""
    rng = random.Random(2)
    pages = [[rng.sample("abcd", rng.randint(1, 3)) for _ in range(n)] for n in (1, 2, 4, 5)]
    labels = [[rng.randint(0, 1) for _ in p] for p in pages]
    sample = htmlmain.Sample(pages, labels)
    k = len(sample.names)

    def mean(theta):
        def score(page, own):
            out = theta[k + own[0]] + sum(theta[k + 2 + 2 * a + b] for a, b in pairwise(own))
            return out + sum(theta[sample.names.index(f)] for block, y in zip(page, own, strict=True) if y for f in block)

        whole = [score(p, own) - np.log(sum(np.exp(score(p, x)) for x in product((0, 1), repeat=len(p)))) for p, own in zip(pages, labels, strict=True)]
        return sum(whole) / len(pages)

    for _ in range(3):
        theta = np.array([rng.uniform(-1.5, 1.5) for _ in range(k + 6)])
        slope = sample.slope(theta)
        for i in range(k + 6):
            step = np.eye(k + 6)[i] * 1e-5
            assert slope[i] == pytest.approx((mean(theta + step) - mean(theta - step)) / 2e-5, abs=2e-5)


def test_pages_labelled_by_hand():
    field = htmlmain.trained()
    wrong = [name for name, html, want in PAGES if htmlmain.extract(html, field) != "\n\n".join(want)]
    assert len(PAGES) == 30 and not wrong


def test_field_on_other_labelled_pages():
    pages, labels = htmlmain.made_pages(200, seed=99)
    field = htmlmain.trained()
    wrong = sum(a != b for p, y in zip(pages, labels, strict=True) for a, b in zip(field.decode(p), y, strict=True))
    assert wrong <= 0.01 * sum(map(len, labels))


def article_of(page: str) -> str:
    """The article of the test tables' layout, by its marks."""
    import html
    import re

    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_main_text_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = htmlmain.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250 and all(r["text"] == article_of(r["html"]) and r["n_chars"] == len(r["text"]) for r in rows)


PAGE = """<html><head><title>T</title><script>var a = "</p><p>x";</script></head><body><header class="site-header"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies.</p></div>
<article><header><h1>A &amp; B&nbsp; title</h1></header><p>First <i>para</i>graph,\n  with &lt;marks&gt;.<br>More.<p>Second paragraph &#233; here.
<div class="ad"><p>Buy now!</p></div><ul><li>Item one is text.</li></ul></article><aside class="sidebar"><h3>Related</h3><p>Other story.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice article.</p></div></section><form><label>Mail</label><button>Go</button></form><footer>&copy; us</footer>"""


def test_main_text_of_a_page():
    assert htmlmain.extract(PAGE, htmlmain.trained()) == "A & B title\n\nFirst paragraph, with <marks>. More.\n\nSecond paragraph é here.\n\nItem one is text."


def test_raw_elements_without_end_tags():
    texts = lambda page: [b.text for b in htmlmain.blocks(page)]
    assert texts("<html><head><meta charset=utf-8><body><article><p>Main text.") == ["Main text."]
    assert texts("<head><title>T</title><style>p</style>x<link href=a><p>Main.") == ["Main."]
    assert texts("<head>x<title>T</title>y</head>z<p>Main.") == ["z", "Main."]
    assert texts("<p>One <svg class=i /> two.</p><p>Three.<svg></svg>") == ["One two.", "Three."]
    assert texts("<p>One <iframe src=a/> two.</p><p>Three.</p><SELECT><option>a") == ["One two.", "Three.", "a"]
    assert texts("<p>One <object data=a/>x</object><svg/><math>y</math> two.<noscript>z</noscript >") == ["One two."]
    assert texts("<p>One<script/>x<p>y") == ["One"] and texts("<p>One<svg class='a") == ["One"]
    assert texts("<p>a <svg>" * 20_000)[-1] == "a"


def test_main_text_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", "<p"), (4, None, "<body><article><p>" + "word " * 50_000), (4, None, "a < b & c <3"), (6, "", "<article class='x\">")]
    out = htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["page_id"] for r in out] == [1, 2, None, 4, 4, 6] and out[0]["text"] == "" and out[3]["n_chars"] == 249_999
    assert htmlmain.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/e"), ("allow", "net", "/es/x"), ("allow", "org", "")]


def plain_filter(host, path):
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_urls_agree_with_plain_matching(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "a.www.Example.COM", "xexample.com", "net", "b.net", "org", "c.org", "de", "", "com.de", "u@net:80"]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/es/", "/es/", "/es/x#f", "/es/xy/z", "/e", "//en/", "/EN/", "#/en/", "?/en/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/", "http:/x", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in urltrie.filter_urls(df, RULES).collect():
        host, path = urltrie.split_url(urls[r["page_id"]])
        assert (r["host"], r["path"], (r["rule"], r["verdict"])) == (host, path, plain_filter(host, path)), urls[r["page_id"]]
    assert urltrie.split_url("http://A.b/C?d#e") == ("a.b", "/C") and urltrie.split_url("x://h#f/") == ("h", "")
    assert urltrie.filter_urls(df.limit(0), RULES).count() == 0
    for bad in ([("maybe", "a", "/")], [("allow", "", "/")]):
        with pytest.raises(ValueError):
            urltrie.Trie(bad)
    both = urltrie.Trie([("block", "a", "/"), ("allow", "a", "/")])
    assert both.find("x.a", "/q") == ("a/", "block")


def test_many_rules_on_one_host():
    rng = random.Random(7)
    rules = {f"/p/{rng.randrange(10**9):x}" for _ in range(50_000)}
    trie = urltrie.Trie([*(("block", "a.com", r) for r in rules), ("allow", "a.com", "/p/")])
    start = time.process_time()
    for r in sorted(rules)[:5000]:
        assert trie.find("b.a.com", r + "zz")[1] == "block"
        assert trie.find("a.com", "/p/-" + r) == ("a.com/p/", "allow")
    assert time.process_time() - start < 2
