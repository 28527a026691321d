"""The filter audit and best-fit packing on small awkward tables, against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonwave.llm import op11_filter_audit as op11
from axonwave.llm import op12_best_fit_packing as op12

R = random.Random(11)
SCHEMA = "doc_id long, text string, source string, fails int, part string, good boolean, state int, task long, piece int, open boolean"
WORDS = ["alpha", "Beta", "gamma,", "über", "日本語", "x1.", "can't", "don't.", "ét́e", "ΣΑΣ", "<|endoftext|>", "a.b,c", "((x).", "!!", "#1", "I'M", "٣٤", "ﬁn", "we're,", "x y", "ź.", "日.", "9."]


def _text(n, words=WORDS):
    return "".join(R.choice(words) + R.choice([" ", "\n", "  ", " \t", "\r\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    many = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n\t", "one two", _text(60), _text(60, many), _text(80, many), "AB cd " + _text(70, many), "a " * 70, "SHOUT " * 60, _text(60, many) + " 100%", "one two", "", _text(9000), _text(3, WORDS) * 5, "日" * 6000, "x" * 5000]
    texts += [_text(R.randint(1, 120), many + ["$", "X"]) for _ in range(40)] + ["same old text " * 20] * 6
    out = [(k, t, [None, "", "a", "b"][k % 4]) for k, t in enumerate(texts)]
    out += [out[5], out[5], (None, "one two", "a"), (None, None, None), (None, "one two", "a")]
    return [(*r, 1, "clash", True, 3, 9, 4, False) for r in out]


@pytest.fixture(scope="module")
def labels():
    return [(k, [0, 1, None][k % 3], [1, 0][k % 2]) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]


def _fails(text, first, doc):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    t = text or ""
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
        "D": re.search(r"[#$%&*|]", t) is not None, "E": doc is not None and first.get(t) is not None and first[t] < doc,
    }


def test_audit_executes_all_orders(spark, rows, labels):
    first, good, toxic = {}, set(), set()
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, quality, bad in labels:
        if doc is not None:
            good |= {doc} if quality == 1 else set()
            toxic |= {doc} if bad == 1 else set()
    parts = defaultdict(list)
    for doc, text, source, *_ in rows:
        parts[source or ""].append((doc, _fails(text, first, doc)))
    want, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                fail = [d for d in docs if d[1][f]]
                want[part, "".join(order), step] = [
                    len(left), len(gone), len(fail) - len(gone), sum(sum(d[1].values()) == 1 for d in fail), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                shapley[part, f] += len(gone)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = op11.audit(docs, op11.text_filters(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(want) == 600 * len(parts)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_nothing_and_of_other_filters(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op11.audit(docs.limit(0), op11.text_filters(), labels).count() == 0
    got = op11.audit(docs, {"Z": F.length("text") > 10, "N": F.lit(None).cast("boolean")}, copies=None, part="part").collect()
    assert len(got) == 4 and {r.filter_order for r in got} == {"ZN", "NZ"}
    assert all(r.removed == 0 for r in got if r.filter_order[r.step - 1] == "N") and {r.part for r in got} == {"clash"}
    with pytest.raises(ValueError):
        op11.audit(docs, {"E": F.lit(True)})


def test_audit_states_are_shared(spark):
    rows = spark.createDataFrame([("p", f, False, True) for f in range(8)], "part string, fails int, good boolean, toxic boolean")
    got = {r.state: r for r in op11.trie_counts(rows, 3).collect()}
    assert sorted(got) == list(range(8))  # one execution a set of filters, not one an order
    assert all(got[s].kept == sum(f & s == 0 for f in range(8)) for s in got)
    assert [[e and e.removed for e in got[s].edges] for s in (0, 5)] == [[4, 4, 4], [None, 1, None]]


def _library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op12.vocabulary()).encode(text or "", add_special_tokens=False).ids


def _ids(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_words_encode_as_whole_texts_do():
    coder = op12.WordCoder(op12.vocabulary())
    texts = [_text(R.randint(0, 60)) for _ in range(300)] + ["", "<|endoftext|>.", "a.́ b", "it's. x", "x'. s", "a b. ́c", "l'été, l'été", "A.,! B", "…. a", "İ. I", "\x1c.\x85 a"]
    texts += ["THE <|ENDOFTEXT|> <|endoftext|>!", "I\u0307. A\u0301, E\u0301;", "a.b. ;: ?x.", "\u212a. \u017f, x\u0345."]
    for k in (0, 5):  # a slice with an offset too, from remembered words
        for t, got in zip(texts[k:], coder.encode_all(pa.array([*texts, None])[k:]), strict=False):
            assert got == _ids(_library(t)), t
    assert coder.encode_all(pa.array([None, ""])) == [b"", b""]


def _checked(pieces, placed, size):
    """Every piece once; sequences gapless and within size. The number of sequences."""
    assert Counter(tuple(r)[:5] for r in pieces) == Counter(tuple(r)[:5] for r in placed)
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_texts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = op12.tokenised(docs, op12.vocabulary(), keep_ids=True)
    have = pieces.collect()
    by = Counter()
    for doc, text, *_ in rows:
        ids = [*_library(text), 1]
        for k in range(0, len(ids), 4096):
            by[doc, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(_ids(ids[k : k + 4096]))] += 1
    assert by == Counter(tuple(r)[:5] for r in have)
    placed = op12.packed(pieces)
    got = placed.collect()
    n, least = _checked(have, got, 4096), -(-sum(r.length for r in have) // 4096)
    assert least <= n <= least + 1
    whole = {r.sequence_id: r for r in op12.sequences(placed).collect()}
    for r in got:
        s = whole[r.sequence_id]
        assert _ids(s.ids[r.offset : r.offset + r.length]) == r.ids and len(s.ids) == s.length <= 4096
    assert op12.packed(op12.tokenised(docs.limit(0), op12.vocabulary())).count() == 0


def _naive(lengths, size, most):
    """Bounded best fit by looking at every open bin."""
    open_, bins = [], 0
    for n in lengths:
        fit = [b for b in open_ if b >= n]
        if fit:
            b = min(fit)
            open_.remove(b)
        else:
            bins, b = bins + 1, size
            if len(open_) == most:
                open_.remove(min(open_))
        if b > n:
            open_.append(b - n)
    return bins, sorted(open_)


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_open_bins_are_best_fit(most):
    lengths = [R.choice([R.randint(1, 99), R.randint(1, 9), 50]) for _ in range(3000)]
    bins = op12.OpenBins(100, most)
    closed = [c for k, n in enumerate(lengths) if (c := bins.put(k, n))]
    left = list(bins.rest())
    used = lambda b: sum(lengths[k] for _, k in b[1:])
    assert len(left) <= most and _naive(lengths, 100, most) == (bins.used, sorted(100 - used(b) for b in left))
    assert sorted(k for b in closed + left for _, k in b[1:]) == list(range(3000))


def test_levels_of_packing(spark):
    """Many tasks and few open bins: levels of the tree, still near the bound, nothing lost; a third of the rows is one row repeated."""
    rows = [(k, 0, 0, R.randint(1, 60), k) for k in range(2000)] + [(None, 0, 0, 7, 1)] * 1000 + [(5000 + k, 0, 0, 100, k) for k in range(10)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(40)
    cfg = op12.Packing(size=100, open_bins=8, fan_in=3)
    n, least = _checked(rows, op12.packed(pieces, cfg).collect(), 100), -(-sum(r[3] for r in rows) // 100)
    assert least <= n <= 1.03 * least
    with pytest.raises(Exception, match="piece of 101"):
        op12.packed(pieces.withColumn("length", F.lit(101)), cfg).count()
