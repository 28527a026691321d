"""The corpus operators on small awkward tables, against plain Python."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonwave.llm import (
    op01_consensus_extraction as op1,
    op02_piece_encoding as op2,
    op03_repeat_intervals as op3,
    op04_fragment_join as op4,
    op05_pivotal_mix as op5,
    op06_radix_dedup as op6,
    op07_url_reputation as op7,
    op08_warc as op8,
    op09_line_frequency as op9,
    op10_line_dedup as op10,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, n long"
R = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "über", "日本", "Ω", "x1", "y22", "the", "of"]


def _text(n):
    return " ".join(R.choice(WORDS) + str(R.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long, passage = _text(3000), _text(60)
    base = _text(100)
    near = base.split(" ")
    near[50] = "changed"
    texts = {
        1: None, 2: "", 3: "  \n\t ", 4: "one two", 5: "ONE two", 6: "one two", 7: long, 8: long, 9: base, 10: " ".join(near), 11: base.upper(),
        12: _text(30) + "\n" + passage, 13: passage + "\n" + _text(40), 14: "a b c d e", 15: "w " * 300, 16: "A,1! b c d e f\nnext line of some words here\na 2 B c d e f", 17: passage + passage,
    }
    out = [(k, t, "en", "src" + str(k % 3) if k % 5 else None, len(t or ""), True, 1) for k, t in texts.items()]
    out.append(out[8])  # a repeated row
    return out + [(None, "null id row " + _text(20), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_empty_tables(empty, spark):
    assert op6.exact_dedup(empty).count() == 0
    assert op4.near_duplicates(empty).count() == 0
    assert op3.without_repeats(empty).count() == 0
    assert op5.mixed(empty).count() == 0
    assert op9.line_quality(empty).count() == 0 and op9.accepted(empty).count() == 0
    assert op10.with_lines_removed(empty).count() == 0
    assert op2.encoded(empty, op2.PieceModel.load(op2.model_path())).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert op1.extract(pages).count() == 0
    assert op7.url_filter(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_extraction(spark):
    art = "<article><h1>Head &amp; tail</h1><p>First  para<br>graph one two three four</p><p>Second <b>bold</b> text</article>"
    menu = "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy</div>"
    div = "<div id=wrap><div class='post-12'><h1>T</h1><p>" + "words here " * 20 + "</p></div><div class='sidebar'>no</div><div id='comments'><p>bad " * 1 + "</p></div></div>"
    pages = [
        (1, "http://a.org/1", f"<html><body>{menu}{art}<footer>&copy;</footer>"), (2, None, f"<body>{div}</body>"), (3, "http://a.org/2", None), (4, "x", ""),
        (5, "http://a.org/3", "<p>only <!-- c --> this<script>var a='<p>'</script>"), (5, "http://a.org/3", "<p>only <!-- c --> this<script>var a='<p>'</script>"),
    ]
    got = {r.page_id: r for r in op1.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & tail First para graph one two three four Second bold text"
    assert got[2].text == "T " + " ".join(["words here"] * 20)
    assert got[3].text == "" and got[4].text == "" and got[5].text == "only this"
    assert got[1].n_chars == len(got[1].text)


@pytest.mark.parametrize("page", [
    "<div class='layout with-sidebar'><article>{}</article><div class=sidebar>no</div></div>", "<div class='no-sidebar'>{}</div>", "<div class=no-header><article>{}</article></div>",
    "<div class='post has-comments'>{}<div class=comments><p>bad bad bad bad</p></div></div>", "<div class='topic social'>{}</div><div class=ad>buy</div>",
    "<form id=aspnetForm><nav>menu</nav><div>{}</div></form>", "<svg/><div>{}</div>", "<div class=sidebar-layout><main>{}</main><div class=sidebar>" + "side words " * 90 + "</div></div>",
    "<article>{}</article><div id=comments><article>" + "a comment " * 90 + "</article></div>", "<div class=header><div class=x>{}</div></div>",
])
def test_wrappers_keep_the_article(page):
    text = "one two three four five six seven"
    for body in (f"<p>{text}</p>", f"<h1>one two three</h1><p>four five <b>six</b></p><p>seven</p>"):
        assert op1.main_text("<html><body>" + page.format(body), None) == text


def test_siblings_and_cdata():
    page = "<body><article><p>first part</p></article><article><p>second part <![CDATA[a < b]]></p></article>"
    assert op1.main_text(page, None) == op1.main_text(page, "html>body>article") == "first part second part a < b"
    assert op1.main_text("<body><div class=ad>only an advert</div></body>", None) == ""


def test_ties_of_votes_and_other_columns(spark):
    page = lambda c: f"<body><div class=n><a href=/>home</a></div><div class={c}><p>{c} text of some words</p></div></body>"
    rows = [(i, f"http://t.org/{i}", page("ab"[i % 2]), "x") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert op1.winning_paths(pages).first().path == "html>body>div.a"
    assert {r.page_id: r.text for r in op1.extract(pages).collect()} == {i: "ab"[i % 2] + " text of some words" for i in range(4)}


def test_host_votes_win(spark):
    page = lambda extra: f"<body><div class=a1><p>{'main text ' * 9}</p></div><div class=b>{extra}</div></body>"
    pages = [(i, "http://h.org/" + str(i), page("<a href=/x>link</a>")) for i in range(5)]
    pages.append((9, "http://h.org/9", page("<p>" + "other text " * 5 + "</p>")))
    won = op1.winning_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).first()
    assert won.path.endswith("div.a#") and won.votes == 5
    got = op1.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id = 9").first()
    assert got.text == " ".join(["main text"] * 9)


def test_encoding_is_the_librarys(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op2.model_path())
    codec = op2.PieceCodec(op2.PieceModel.load(op2.model_path()))
    alphabet = ["a", "the", " ", "   ", "é", "\n", "日", "😀", "▁", "<s>", "0", "ing", "\x00"]
    for t in [r[1] or "" for r in rows] + ["".join(R.choice(alphabet) for _ in range(R.randint(0, 40))) for _ in range(500)] + ["=" * 500]:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(packed) == sp.decode(ids)
    got = op2.encoded(docs, op2.PieceModel.load(op2.model_path()), keep_ids=True).where("doc_id = 2").first()
    assert got.ids == [1, 2] and got.n_tokens == 2 and got.decoded == ""


def test_repeats(docs, rows):
    got = {r.doc_id: r for r in op3.without_repeats(docs).collect()}
    seen = set()
    for i, t in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        r = got[None if i < 0 else i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), sum(gone), hashlib.sha256(kept).hexdigest()), i
        assert r.n_spans == len([x for x in bytes(gone).split(b"\0") if x])


def test_repeats_of_documents_with_one_id(spark):
    rnd = random.Random(8)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, line = some(413), some(70)
    rows = [(None, some(50) + passage), (None, passage + some(60)), (1, some(20) + passage + some(9)), (2, passage + "x"), (2, some(300) + passage), (2, passage + "x"), (3, "ab" * 400), (None, None)]
    rows += [(i, some(40) + line + some(40) + (passage if i % 5 == 0 else "") + ("zz" * 70 if i % 7 == 0 else "")) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS th").distinct().collect()
    want, seen = {}, set()
    for r in sorted(keyed, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.th)):
        raw = (r.text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        want[r.doc_id, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()] = sum(gone)
    for plan in (op3.RepeatPlan(), op3.RepeatPlan(held_bytes=2000, windows=300, seen=8)):
        got = op3.without_repeats(docs, plan).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.kept_sha256): r.n_removed for r in got} == want
    groups = op3.repeat_groups(docs, op3.RepeatPlan(held_bytes=2000)).collect()
    assert {1, 2, 10, 55} <= {r.doc for r in groups if r.first_doc == op3.NO_DOC}


def test_equal_hashes_of_other_bytes(monkeypatch):
    rng = np.random.default_rng(4)
    runs = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(runs), np.uint8), np.arange(0, 901, 30)
    found = lambda: sorted((n, *sorted(zip(run.tolist(), place.tolist()))) for n, run, place in op3.maximal_repeats(data, offsets, 10, 30))
    want = found()
    monkeypatch.setattr(op3, "_window_hashes", lambda d, at, size: (d[at].astype(np.uint64)))
    assert found() == want


def test_maximal_repeats_have_all_occurrences():
    rng = np.random.default_rng(2)
    runs = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(runs), np.uint8), np.arange(0, 1201, 30)
    for n, run, place in op3.maximal_repeats(data, offsets, 10, 30):
        word = runs[run[0]][place[0] : place[0] + n]
        every = {(i, p) for i, r in enumerate(runs) for p in range(31 - n) if r[p : p + n] == word}
        assert every == set(zip(run.tolist(), place.tolist())) and len(every) > 1


def test_near_duplicates(docs, rows):
    sets = {}
    for r in rows:
        w = _words(_lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    both = [x for x in (group[a], group[b]) if x is not None]
                    group[a] = group[b] = min(both) if both else None
    got = op4.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), group[r.doc_id]), r


def test_many_near_copies_are_one_group(spark):
    base = _text(120).split(" ")
    texts = []
    for i in range(60):
        w = list(base)
        w[R.randrange(120)] = f"new{i}"
        texts.append((i, " ".join(w)))
    got = op4.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), None, "abc"[i % 3] if i % 7 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cfg = op5.Mix(bucket_rows=40, fan_in=4)
    got = op5.mixed(docs, cfg=cfg).toPandas()
    again = op5.mixed(docs.repartition(7), cfg=cfg).toPandas()
    assert (got.sort_values("doc_id").taken.to_numpy() == again.sort_values("doc_id").taken.to_numpy()).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert (abs(by.target - by.taken) <= 5).all() and (got.taken <= 2 * got["size"]).all() and (by.target <= 2 * by["size"] + 1e-9).all()


def test_mix_settles_large_documents(spark):
    rows = [(i, " ".join(["w"] * (4000 if i == 3 else 1500 if i % 50 == 0 else 5 + i % 90)), "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cfg in (op5.Mix(), op5.Mix(bucket_rows=100, reserve=20), op5.Mix(seed=11)):
        got = op5.mixed(docs, cfg=cfg).toPandas()
        by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), median=("size", "median"))
        assert (abs(by.target - by.taken) <= by["median"]).all()


def test_mix_is_unbiased():
    size = np.array([900.0, 300, 200, 100, 90, 80, 70, 60, 50, 40, 30, 20, 10])
    mean = np.zeros(len(size))
    for k in range(4000):
        u = np.array([hash((k, i)) for i in range(len(size))])
        p = op5._settled(np.full(len(size), 0.3), size, u, 3)
        assert abs(p @ size - 0.3 * size.sum()) < 1e-6 and (p >= 0).all() and (p <= 1).all()
        mean += p / 4000
    assert (abs(mean - 0.3) < 0.04).all()


def test_exact_dedup(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(_lower(r[1]), []).append(r[0])
    text = {r[0]: _lower(r[1]) for r in rows}
    for r in op6.exact_dedup(docs).collect():
        own = groups[text[r.doc_id]]
        keep = max((x for x in own if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(own), r.doc_id == keep, hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_urls(spark):
    urls = ["http://A.net/x", "https://b.example.net/en/1?q", "http://example.com/de/2#f", "http://q.org/fr/3", "nothing", None, "http://bad.test/7", "http://bad.test/8", "ftp://z.net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    got = {r.page_id: r for r in op7.url_filter(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert [got[i].rule for i in range(9)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert (got[0].host, got[1].path, got[2].path, got[4].host, got[5].path, got[8].path) == ("a.net", "/en/1", "/de/2", "", "", "")


def test_reputation_needs_evidence(spark):
    out = [("bad.a.com", 1)] * 40 + [("good.a.com", 0)] * 60 + [("few.b.com", 1)] + [(f"h{i}.b.com", 0) for i in range(30)] + [("none.c.com", None)]
    got = {r.host: r.blocked for r in op7.host_reputation(spark.createDataFrame(out, "host string, bad int")).collect()}
    assert got["bad.a.com"] and not got["good.a.com"] and not got["few.b.com"] and not got["none.c.com"]


def test_warc(spark, tmp_path):
    big = "é\r\nWARC/1.1\r\n\r\n" * 400
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u\r\nX: y", "\r\n"), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    op8.write_archives(op8.segments(df, chunk_chars=100), str(tmp_path / "w"))
    got = {r.page_id: r for r in op8.read_archives(spark, str(tmp_path / "w")).collect()}
    for k, _, t in pages:
        raw = (t or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert [got[k].record_type for k in (1, 2, 3, 4, None)] == ["response", "revisit", "response", "response", "response"]
    assert got[2].refers_to == 1 and got[1].n_chunks == -(-len(big) // 100) and got[2].n_chunks == 1


def test_warc_of_no_pages_repeated_rows_and_other_columns(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    op8.write_archives(op8.segments(none), str(tmp_path / "none"))
    assert op8.read_archives(spark, str(tmp_path / "none")).count() == 0
    long = "some text \U0001f600 of a page\r" * 20
    rows = [(1, "u", long, "x", 1), (1, "u", long, "x", 1), (2, "u", long, "y", 2), (2, "u", long, "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string, sha int")
    op8.write_archives(op8.segments(df, chunk_chars=64), str(tmp_path / "w"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.n_chunks) for r in op8.read_archives(spark, str(tmp_path / "w")).collect())
    sha = hashlib.sha256(long.encode()).hexdigest()
    assert got == [(1, "response", None, sha, -(-len(long) // 64))] * 2 + [(2, "revisit", 1, sha, 1)] * 2


def test_warc_damage_is_an_error():
    lines = "WARC/1.1|WARC-Type: response|WARC-Record-ID: <urn:axonwave:page:1>|WARC-Payload-Digest: sha256:00|WARC-Payload-Length: 2|Content-Length: 2||ab||".split("|")
    with pytest.raises(ValueError, match="differs"):
        list(op8.records_of(("f", x) for x in lines))


def test_quality(docs, rows, spark):
    text = {r[0]: r[1] or "" for r in rows}
    for r in op9.line_quality(docs).collect():
        t = text[r.doc_id]
        w = _words(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(grams) < 400 else set()
        lines = [x for x in t.split("\n") if _words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        if len(grams) < 400:
            assert r.n_repeat_words == len(hit)
    boiler = "the same notice on every page of this host for all readers to see"
    many = spark.createDataFrame([(i, boiler + "\n" + _text(9 if i < 3 else 60), "h") for i in range(40)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in op9.line_quality(many).collect()}
    assert not got[0].kept and got[10].kept and got[10].n_removed_words == 14
    assert {r.text.count("notice") for r in op9.accepted(many).collect()} == {0}


def test_lines(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    rows = [(1, "Same line, of FIVE words 1!\nown text of the first document"), (2, "same line of five words 2\nshort one"), (3, long), (4, long.replace("wordaa ", "wordzz ", 1) + "\nand another line that is kept"), (5, None)]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in op10.with_lines_removed(docs).collect()}
    assert got[1].n_removed == 0 and got[2].text == "short one" and not got[2].dropped and got[5].text is None
    assert got[4].text == "and another line that is kept" and got[4].n_chars == len(got[4].text)
    assert {r.doc_id for r in op10.deduped(docs).collect()} == {1, 2, 3, 4, 5}
    assert {r.doc_id for r in op10.deduped(docs, op10.LinePlan(most_lost=0.7)).collect()} == {1, 3, 5}
    own = docs.selectExpr("*", "'mine' AS dropped", "7 AS n_lines", "1 AS _found")
    assert {(r.dropped, r.n_lines, r._found, r.lang) for r in op10.deduped(own).collect()} == {("mine", 7, 1, "x")}


def edit_distance(a: str, b: str) -> int:
    """Row by row, vectorised over the columns."""
    x, at = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    row = at.copy()
    for i, c in enumerate(a):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (x != ord(c)))])
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def test_texts_meet_their_lost_lines_without_a_sort(spark):
    """The same join at every size: its shuffle grows as the texts do, and texts are not sorted."""
    docs = spark.createDataFrame([(k, f"a line that all of them have\nnumber {k}") for k in range(4)], "doc_id long, text string")
    out = op10.with_lines_removed(docs)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert {r.doc_id: r.text for r in out.collect()} == {0: "a line that all of them have\nnumber 0"} | {k: f"number {k}" for k in range(1, 4)}


def test_similar_lines_are_found(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    vocab = [word() for _ in range(4000)]
    lines = []
    for _ in range(250):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 50))]
        v = list(w)
        for _ in range(rnd.randint(1, max(1, len(w) // 8))):
            k = rnd.randrange(len(v))
            v[k : k + 1] = rnd.choice([[rnd.choice(vocab)], [], [v[k], rnd.choice(vocab)]])
        lines += [" ".join(w), " ".join(v)]
    lines = [x for x in dict.fromkeys(lines) if len(x.split()) >= 5]
    found, pairs, first = _recall(spark, lines)
    assert len(pairs) > 150 and found >= 0.95 * len(pairs)
    assert all((first[i], i) in pairs or (i, first[i]) in pairs or i == first[i] for i in first)


def _recall(spark, lines):
    """(pairs found, pairs of edit similarity 0.8 by brute force, the first of each line's group)."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    from axonwave.llm.common import written

    table = written(op10.line_table(docs, op10.LinePlan()))
    first = {r.doc: r.first.doc for r in op10.line_groups(table).collect()}
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    n = np.array([len(lines[i]) for i in order])
    grams = np.array([np.bincount([hash(lines[i][k : k + 2]) % 512 for k in range(len(lines[i]) - 1)], minlength=512) for i in order], np.int32)
    pairs = set()
    for k, i in enumerate(order):
        to = np.searchsorted(n, n[k] / 0.8 + 1e-9, "right")
        near = np.flatnonzero(abs(grams[k + 1 : to] - grams[k]).sum(1) <= 4 * 0.2 * n[k + 1 : to] + 2) + k + 1
        pairs |= {(i, order[j]) for j in near if edit_distance(lines[i], lines[order[j]]) <= 0.2 * n[j]}
    found = sum(i in first and first[i] == first.get(j) for i, j in pairs)
    print(f"{found} of {len(pairs)}")
    return found, pairs, first


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_similar_lines_of_the_documents_are_found(spark):
    import re

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    split = lambda x: [w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", _lower(x)) if w]
    lines = list(dict.fromkeys(" ".join(w) for t in texts for x in t.split("\n") if len(w := split(x)) >= 5))
    found, pairs, _ = _recall(spark, [x for x in lines if len(x) < 3000])
    assert len(pairs) >= 40 and found >= 0.9 * len(pairs)


def test_numbers_stay_apart_in_short_lines(spark):
    rows = [(1, "Item 12 costs 345 now"), (2, "Item 98 costs 761 now"), (3, "Item 12, costs 345: now")]
    got = {r.doc_id: r.n_removed for r in op10.with_lines_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_close_is_edit_similarity():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    for _ in range(1500):
        x = [rnd.choice(words) for _ in range(rnd.randint(1, 25))]
        y = list(x)
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(y) + 1)
            y[k : k + rnd.randint(0, 2)] = [rnd.choice(words) for _ in range(rnd.randint(0, 2))]
        a, b = " ".join(x), " ".join(y)
        assert op10.edit_distance(a, b) == edit_distance(a, b)
        for s in (0.8, 0.6):
            assert op10.close(a, b, s) == (edit_distance(a, b) <= (1 - s) * max(len(a), len(b)) + 1e-9), (a, b, s)


def test_many_pairs_are_tested_at_once():
    """Patterns of one word of 64 bits and of several, at and beside their ends, in numbers that are stepped through together and alone."""
    rnd = random.Random(8)
    pairs = []
    for _ in range(900):
        letters = rnd.choice(("abcde ", "ab\u4e2d\u6587\U00020000 "))
        a = [rnd.choice(letters) for _ in range(rnd.choice((0, 1, 63, 64, 65, 127, 128, 129, rnd.randint(1, 190))))]
        b = list(a)
        for _ in range(rnd.randint(0, 1 + len(a) // 3)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randint(0, 2)] = [rnd.choice(letters) for _ in range(rnd.randint(0, 2))]
        pairs.append(("".join(a), "".join(b)))
    pairs += [("x" * 3000, "x" * 2900 + "y" * 100), ("x" * 3000, "y" * 3000)]
    for n in (len(pairs), 5, 0):
        a, b = [x for x, _ in pairs[-n:] if n], [y for _, y in pairs[-n:] if n]
        want = [edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9 for x, y in zip(a, b, strict=True)]
        assert op10.close_pairs(a, b, 0.8).tolist() == want


def test_far_pairs_take_no_exact_distance(monkeypatch):
    """Their characters tell, in texts that no cheaper look settles."""
    a, b = "alpha beta gamma delta " * 9 + "omega", "xi psi tau rho " * 13 + "omega s"
    monkeypatch.setattr(op10, "edit_distance", lambda *_: pytest.fail("an exact distance"))
    monkeypatch.setattr(op10, "_distances", lambda *_: pytest.fail("exact distances"))
    assert op10.close_pairs([a] * 40, [b] * 40, 0.8).tolist() == [False] * 40


def test_signs_are_majorities():
    """In lines of few words and of more than a byte counts."""
    count = np.array([1, 2, 7, 255, 256, 700])
    words = np.random.default_rng(2).integers(0, 1 << 63, count.sum(), np.uint64) * np.uint64(2) + np.uint64(1)
    for some in (count, count[:4]):
        begin = np.cumsum(some) - some
        want = [sum(1 << k for k in range(64) if 2 * sum(int(w) >> k & 1 for w in words[i : i + c]) > c) for i, c in zip(begin, some, strict=True)]
        assert op10.signs(words[: some.sum()], begin, some).tolist() == want


def test_unspaced_characters():
    text = "a\u4e00\u0e01\u0e81\u1000\u1780\u00fc\U00020000\U0001f600\uac00 z\u6587"
    data = np.frombuffer(text.encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    assert "".join(c for c, i in zip(text, lead, strict=True) if op10.unspaced(data)[i]) == "\u4e00\u0e01\u0e81\u1000\u1780\U00020000\u6587"
    assert op10.unspaced(data).sum() == 7 and not op10.unspaced(data[:0]).size and op10.unspaced(data[-3:-2]).all()


def test_equal_buckets_are_one(spark, monkeypatch):
    """Buckets with the same nodes make the same pairs: later steps have them once."""
    from axonwave.llm import linkage

    sizes, keep = [], linkage.written

    def counted(df, label="step", **options):
        out = keep(df, label, **options)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(linkage, "written", counted)
    rows = [(k, n, 9) for k in range(6) for n in (1, 2, 3)] + [(10, 3, 9), (10, 4, 9), (11, 5, 9), (11, 6, 9), (12, 7, 9)]
    groups = linkage.linked_groups(spark.createDataFrame(rows, "bucket long, node long, n int"), lambda pairs: pairs.where("a < 5"), carry=("n",), plain=True)
    assert {r.node: r.component for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert sizes[0] == ("left", 7)


def test_slices_hold_what_their_rows_do(spark):
    from axonwave.llm.common import written

    line = "a line of caf\u00e9s that some of the others have"
    rows = [(1, f"{line}\nshort\n{line}!"), (2, f"{line} too\nshort"), (3, "nothing\n\n"), (4, None), (5, f"own words of this one\n{line.upper()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = [{(r.doc, r.pos, r.words, r.doc_words, r.first.doc, r.first.pos) for r in op10.line_groups(written(f(docs, op10.LinePlan()))).collect()} for f in (op10.line_slices, op10.line_table)]
    assert groups[0] == groups[1] and {x[:2] for x in groups[0]} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (5, 1)}
    long = {(r.doc, r.pos): (r.n, r.line) for r in op10.line_table(docs, op10.LinePlan()).collect() if r.line is not None}
    assert all(n == len(text) for n, text in long.values()) and long[1, 0][1] == line and (1, 2) not in long


def test_words_of_all_lines_and_normalised_text_come_from_one_pass(spark):
    rows = [(1, " One, TWO  three-four 'five'!\nsix\n\n...\nseven"), (1, " One, TWO  three-four 'five'!\nsix\n\n...\nseven"), (2, None), (3, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = op10.line_table(docs, op10.LinePlan()).collect()
    assert {(r.doc, r.pos, r.words, r.doc_words) for r in lines} == {(1, 0, 5, 7), (1, 1, 1, 7), (1, 4, 1, 7), (3, 0, 5, 5)}
    assert {r.line for r in lines if r.line is not None} == {"one two three four five"}
    gone = {r.doc: (r.lost, r.dropped) for r in op10.removed_lines(docs.unionByName(docs.where("doc_id = 3"))).collect()}
    assert gone == {3: ([0], True)}  # repeated rows lose no more and hold no more


def test_a_bitmap_takes_one_job(spark):
    """Whatever the number of partitions."""
    from axonwave.llm import repeats

    hashes = np.random.default_rng(4).integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2)
    hashes[1000:1500] = hashes[:500]
    rows = [(int(o), hashes[k::4][repeats.owner_of(hashes[k::4], 8) == o].tobytes()) for k in range(4) for o in range(8)]
    key, context = "spark.sql.adaptive.coalescePartitions.enabled", spark.sparkContext
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    context.setJobGroup("a bitmap", "")
    try:
        got = repeats.bitmap_of(spark.createDataFrame(rows, "owner int, hashes binary"), 8, 16)
    finally:
        spark.conf.set(key, before)
        context.setLocalProperty("spark.jobGroup.id", None)
    want = np.zeros(1 << 16, bool)
    want[(hashes[:500] >> np.uint64(48)).astype(np.int64)] = True
    assert (got == np.packbits(want)).all()
    assert len(context.statusTracker().getJobIdsForGroup("a bitmap")) <= 2  # the shuffle's and the result's


def test_short_and_unspaced_lines(spark):
    zh = "\u4eca\u5929\u6211\u4eec\u4e00\u8d77\u53bb\u516c\u56ed\u770b\u82b1\u7136\u540e\u56de\u5bb6\u5403\u996d"
    rows = [(1, f"les.\nchapter 1\n{zh}"), (2, f"Les\nchapter 2\n{zh[:8]}\u5c71{zh[9:]}"), (3, f"les\n{zh[::-1]}"), (4, "\u7b2c\u4e00"), (5, "\u7b2c\u4e00\nb"), (6, "les")]
    got = {r.doc_id: r for r in op10.with_lines_removed(spark.createDataFrame(rows, "doc_id long, text string"), op10.LinePlan()).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "chapter 2", 3: zh[::-1], 4: "\u7b2c\u4e00", 5: "b", 6: ""}
    assert [i for i, r in got.items() if r.dropped] == [6]


def test_components_in_one_task_and_in_rounds(spark):
    from axonwave.llm.linkage import components

    links = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, 5), (100, 200), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    a, b = ({r.node: r.component for r in components(df, n).collect()} for n in (1000, 0))
    a.pop(7, None), b.pop(7, None)
    assert a == b and a[200] == 1 and a[14] == 8
    assert components(df.where("false")).count() == 0
