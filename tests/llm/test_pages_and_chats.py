"""Operators on pages and conversations, and the pipeline, against plain definitions."""

import base64
import gzip
import hashlib
import os
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import ODD, docs_of
from pyspark.sql import functions as F

from speechspark.llm import chat, html_text, url_filter, warc

SF = "/root/testdata/sf0.001"
P = "<p>" + "Some words of the article stand here, and more of them follow. " * 4 + "</p>"
T = " ".join(["Some words of the article stand here, and more of them follow."] * 4)

PAGES = {
    "sidebar": (f"<header><a href=/>Site</a></header><div class=content><h1>Title</h1>{P}{P}</div><div class='left sideBar'><a>x</a>{P}{P}</div>", f"Title\n{T}\n{T}"),
    "comments": (f"<main><article><h1>T</h1>{P}<form>name <input><button>go</button></form></article><section id=comments><article>{P}{P}{P}</article></section></main>", f"T\n{T}"),
    "notice": (f"<h1>T</h1>{P}<div class='cookieNotice'>We use cookies</div>{P}", f"T\n{T}\n{T}"),
    "sections": (f"<div id=wrap><div class=menu><a>1</a></div><div><section><h2>A</h2>{P}</section><section><h2>B</h2>{P}{P}</section></div><div class='related-posts'>{P}</div></div>", f"A\n{T}\nB\n{T}\n{T}"),
    "layout class": (f"<div class='content-with-sidebar'><h1>T</h1>{P}</div><aside>{P}{P}{P}</aside>", f"T\n{T}"),
    "menu without a name": (f"<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div><h1>T</h1>{P}{P}</div><div><a>imprint</a></div>", f"T\n{T}\n{T}"),
    "open tags": ("<article><h1>T</h1><p><b>one<br>two<p>three <i>four<p>five", "T\none two\nthree four\nfive"),
    "references": ("<article><p>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xe9; &copy &unknown; &am</p></article>", "a <b> &amp; ééé © &unknown; &am"),
    "attributes": ("<article><p title='x > y'>one</p><p hidden>no</p><p style='display: none'>no</p><!-- no --><p>two</p></article>", "one\ntwo"),
    "raw text": ("<article><script>if (a<b) '</p>'</script><style>p{}</style><p>one</p><noscript>no</noscript></article>", "one"),
    "lists": ("<article><p>in</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>", "in\none\ntwo\na\nb\nx y"),
    "words without tags": ("just   text", "just text"),
    "only boilerplate": ("<nav><a>a</a></nav><footer>f</footer>", ""),
    "deep": ("<div>" * 3_000 + "<p>deep</p>", "deep"),
    "cut off": ("<article><p>one</p><p>two <a href='x", "one\ntwo"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_density_falls_with_links():
    plain = html_text.measure(html_text.parse(f"<div>{P}</div>"))
    linked = html_text.measure(html_text.parse(f"<div>{P.replace('words of the article', '<a href=x>words of the article</a>')}</div>"))
    assert plain[1].density > linked[1].density and plain[0].total > 0


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("i", "u", "h", "p", "d", "n", "text", "shard", "cell", "o", "least", "host", "path"):
        df = df.withColumn(name, F.lit("clash"))
    return df


ODD_PAGES = [
    (None, None, None), (1, "http://a.org/x", ""), (2, "", "<p>x</p>"), (2, "", "<p>x</p>"), (2, "other", "<p>y</p>"),
    (3, "no scheme", "<p>x</p>"), (None, "https://b.com/de/1?a=1&b=2#f", "<p>x</p>"), (4, "http://c.net", "<p>" + "lang " * 200_000 + "</p>"),
    (5, "http://c.net/a\r\nb", "é😀" * 5), (10**15, "http://c.net", "<p>far</p>"),
]


def test_text_of_odd_pages(spark):
    got = html_text.extract_text(pages_of(spark, ODD_PAGES))
    want = [(i, u, t := html_text.main_text(h), len(t)) for i, u, h in ODD_PAGES]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert html_text.extract_text(pages_of(spark, [])).count() == 0


def test_text_of_the_given_pages(spark):
    """Titles and paragraphs of the article element, which these pages all have."""
    import html
    import re

    for r in html_text.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- 2: urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:at], rest[at:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


URLS = ["http://Example.ORG/es/1", "http://x.example.org/es", "http://badexample.org/es/", "https://example.org/en/12", "http://a.com/fr/", "http://a.com/FR/",
        "http://com/de/x", "ftp://org?x/y", "http://a.net/fr/", "x", "", None, "http://É.org/#/a", "://", "http://u:p@a.org:8/?a=1&b=2"]


def test_url_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows).collect()}
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["blocked"] > 0.5 else "allow"))
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_urls_of_odd_pages(spark):
    assert url_filter.judge_urls(pages_of(spark, ODD_PAGES)).count() == len(ODD_PAGES)


def test_trees_on_held_out_urls(spark):
    """Spam hosts with digits, dashes and parameters against plain ones; a third is held out."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    rows = []
    for k in range(900):
        if bad := k % 2:
            url = f"http://{word()}-{rng.integers(10**6)}.{word()}.biz/{rng.integers(10**8)}?id={rng.integers(10**6)}&x={word()}&y={rng.integers(99)}"
        else:
            url = f"http://www.{word()}.edu/{word()}/{word()}"
        rows.append((k, url, float(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label double")
    seen, held = df.filter("page_id % 3 > 0"), df.filter("page_id % 3 = 0")
    got = url_filter.judge_urls(held, rules=(), labelled=seen)
    right = got.join(df, "page_id").filter((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert right >= 0.97 * held.count()
    again = url_filter.judge_urls(held, rules=(), labelled=seen)
    assert sorted(got.collect()) == sorted(again.collect())


def test_entropy(spark):
    row = spark.createDataFrame([("aabc", "h", "/p")], "url string, host string, path string")
    assert abs(url_filter.lexical(row).first()["entropy"] - 1.5) < 1e-12


# --- 5: chats


def plain_digest(turns):
    turn = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), turn, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_conversations_come_back(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 1, "assistant", "tie"), (2, 0, "sys\ntem\\n", "<|im_end|>\n<|im_start|>x\n"), (2, 1, "assistant", "<||im_end|> < | <|"),
        (3, None, None, None), (None, 0, "user", "a"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long " * 100_000), (6, 0, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9)).withColumn("message", F.lit("clash"))
    got = {r["conv"]: tuple(r)[1:5] for r in chat.read_back(chat.render(chat.fold_events(chat.events_of_rows(df), chat.MESSAGE))).collect()}
    want = defaultdict(list)
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    assert got == {c: plain_digest(t) for c, t in want.items()}
    assert chat.read_back(chat.render(chat.fold_events(chat.events_of_rows(df.limit(0)), chat.MESSAGE))).count() == 0


def test_events_are_folded(spark):
    e = [
        (1, 1, "q", "message", "user", "hi"), (1, 2, "a", "message", "assistant", None), (1, 3, "a", "delta", None, "wor"), (1, 4, "a", "delta", None, "ld"),
        (1, 5, "a", "regenerate", None, None), (1, 6, "a", "delta", None, "new "), (1, 7, "a", "delta", None, "text"), (1, 7, "a", "delta", None, "text"),
        (1, 8, "q", "edit", None, "hello"), (1, 9, "z", "unknown", "user", "ignored"), (2, 1, "d", "delta", "assistant", "lone"), (1, 10, "t", "message", "user", "thanks"),
    ]
    df = spark.createDataFrame(e, "conv long, seq long, message string, kind string, role string, text string")
    got = chat.fold_events(df.repartition(5)).orderBy("conv", "seq").select("conv", "role", "text").collect()
    assert [tuple(r) for r in got] == [(1, "user", "hello"), (1, "assistant", "new text"), (1, "user", "thanks"), (2, "assistant", "lone")]


@pytest.mark.parametrize("text", ["", "<|", "<||", "<|im_end|>", "<<|||im_start|>", "a<|b<||c", "\n<|im_start|>user\n"])
def test_escape_round_trip(spark, text):
    df = spark.createDataFrame([(1, 1, 1, text, text)], "conv long, seq long, message long, role string, text string")
    r = chat.render(df, learned=text).first()
    assert chat.parse_piece(r["piece"]) == [(text, text)]
    assert r["piece"].count(chat.END) == 1 and r["piece"].count(chat.START) == 1
    assert chat.unescape(r["piece"][r["mask_start"]:r["mask_start"] + r["mask_chars"]]) == text


# --- 8: WARC


def plain_records(rows, least_bytes=0):
    seen, least = set(), {}
    body = lambda h: (h or "").encode()
    for i, _, h in rows:
        if i is not None:
            least[body(h)] = min(i, least.get(body(h), i))
    out = []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, body(r[2]))):
        b = body(h)
        first = (least.get(b) == i or b not in least) and (i, b) not in seen
        seen.add((i, b))
        revisit = not first and len(b) >= least_bytes
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "revisit" if revisit else "response", least.get(b) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_bytes", [0, 9])
def test_archives_of_odd_pages(spark, least_bytes):
    folder = tempfile.mkdtemp(prefix="warc-")
    manifest = warc.write_archives(pages_of(spark, ODD_PAGES), folder, shard_mb=0.01, file_mb=0.001, min_revisit_bytes=least_bytes)
    got = warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_records(ODD_PAGES, least_bytes)
    empty = tempfile.mkdtemp(prefix="warc-")
    none = warc.write_archives(pages_of(spark, []), empty)
    assert none.count() == 0 and warc.read_archives(none, empty).count() == 0


def test_far_off_ids_and_crowded_ids_spread_over_shards(spark):
    ids = [-(2**63), 2**63 - 1, None, *range(400), *[7] * 300, *[None] * 300]
    rows = [(i, "http://a", f"{k} " * 200) for k, i in enumerate(ids)]
    folder = tempfile.mkdtemp(prefix="warc-")
    manifest = warc.write_archives(pages_of(spark, rows), folder, shard_mb=0.03, file_mb=0.01)
    per_shard = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert sum(per_shard) == len(rows) and max(per_shard) < 100
    names = [r["name"] for r in manifest.orderBy("name").collect()]
    order = []
    for name in names:
        with gzip.open(f"{folder}/{name}") as stream:
            order += [x["page_id"] for x in warc.read_records(stream)]
    assert order == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert warc.read_archives(manifest, folder).filter("record_type = 'response'").count() == len(rows)


def test_archives_are_the_same_in_every_run(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seen = []
    for df in (pages, pages.repartition(5)):
        folder = tempfile.mkdtemp(prefix="warc-")
        manifest = warc.write_archives(df, folder, shard_mb=0.05, file_mb=0.01)
        rows = manifest.orderBy("name").collect()
        assert len({r["shard"] for r in rows}) > 2 and len(rows) > len({r["shard"] for r in rows})
        for r in rows:
            data = open(f"{folder}/{r['name']}", "rb").read()
            assert hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert not [x for x in os.listdir(f"{folder}/_temporary")]
        seen.append([(r["name"], r["sha256"], r["records"]) for r in rows])
    assert seen[0] == seen[1]


def test_damage_is_noticed():
    import io

    good = warc.record(1, "http://a", b"payload", False, None)
    assert [x["payload"] for x in warc.read_records(io.BytesIO(good + good))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(good.replace(b"payload\r\n", b"PAYLOAD\r\n"))))


# --- the pipeline


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    from test_documents import ITEMS, plain_components, plain_counts, plain_hits, plain_print, plain_repeats  # noqa: F401

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if (n := plain_counts(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    roots = plain_components({i: plain_print(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if roots[i] == i}
    kept = plain_repeats([t.split() for t in rows.values()], 35)
    rows = {i: t if len(k) == len(t.split()) else " ".join(k) for (i, t), k in zip(rows.items(), kept) if k}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {i: t for i, t in rows.items() if not plain_hits(t, items, 10)[1]}

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    assert {r["doc_id"]: r["text"] for r in now.collect()} == rows
    mixed = corpus_pipeline.run(spark, SF)
    got = mixed.select("doc_id", "text").distinct().collect()
    assert got and all(rows[r["doc_id"]] == r["text"] for r in got)


def test_stages_on_odd_and_no_rows(spark, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert set(odd.columns) <= set(out.columns), name
        assert name == "mix" or out.columns == odd.columns, name
    deduped = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, odd, SF).collect()]
    assert (6, "A B c d e f") in deduped and deduped.count((6, "A B c d e f")) == 1
    assert [i for i, t in deduped if not (t or "").split()] == [1]
    ids = [i for i, _, _ in ODD if i not in (None, 6, 2, 3)]
    assert {i for i, _ in deduped} >= {i for i in ids if i not in (7, 8)}
    assert docs_of(spark, []).columns == none.columns
