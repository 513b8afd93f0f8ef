"""Learned and measured parts held against plain versions: licence notices, quality divergences, FTRL."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import regex

from ledgerlens.llm import license_scan as L
from ledgerlens.llm import quality, toxicity
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def notices_by_hand(words, index):
    """Every notice at every beginning, without an index."""
    labels, best, spans = set(), 0.0, []
    for t, (label, notice, keys) in enumerate(index.notices):
        rare = sorted(set(notice), key=lambda w: (-index.idf[w], w))[:L.ANCHORS]
        for start in range(-len(notice) + 1, len(words)):
            here = {k: words[start + k] for k in range(len(notice)) if 0 <= start + k < len(words)}
            if sum(here.get(k) == w for k, w in enumerate(notice) if w in rare) < index.needed[t]:
                continue
            part = words[max(start, 0):min(start + len(notice), len(words))]
            if not any(tuple(part[i:i + len(key)]) == key for key in keys for i in range(len(part))):
                continue
            share = sum(index.idf[w] for k, w in enumerate(notice) if here.get(k) == w) / sum(
                index.idf[w] for w in notice)
            best = max(best, share)
            if share >= L.LEAST_SHARE:
                labels.add(label)
                spans.append((label, max(start, 0), start + len(notice)))
    return labels, min(best, 1.0), sorted(spans)


def test_license_notices_equal_a_search_everywhere():
    rnd = random.Random(8)
    index = L.build_index({w: rnd.randint(0, 50) for w in L.vocabulary()}, 60)
    vocabulary = sorted(L.vocabulary())
    for _ in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 25))]
        for _ in range(rnd.randint(0, 3)):
            notice = list(rnd.choice(index.notices)[1])
            if rnd.random() < 0.5:  # damaged: cut off or some words replaced
                notice = notice[rnd.randint(0, 4):len(notice) - rnd.randint(0, 4)]
                for _ in range(rnd.randint(0, 3) if notice else 0):
                    notice[rnd.randrange(len(notice))] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(words))
            words[at:at] = notice
        got = L.scan(words, index)
        labels, best, spans = notices_by_hand(words, index)
        base = set(filter(None, got["base_labels"].split(",")))
        assert set(filter(None, got["labels"].split(","))) == labels | base
        assert abs(got["score"] - best) < 1e-9
        assert [(s["label"], s["start_word"], s["end_word"]) for s in got["spans"]] == spans


def histograms(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    word_chars = sum(map(len, words))
    found = [len(regex.findall(p, text or "")) for p in (
        r"\p{Lu}", "[0-9]", r"""[.,;:!?'"()\[\]-]""", quality.SYMBOLS)]
    chars = [max(word_chars - sum(found), 0), *found, max(len(text or "") - word_chars, 0)]
    hits = Counter(w.rstrip(".,;:!?").lower() for w in words)
    common = [hits[w] for w in quality.COMMON_WORDS]
    return len(words), chars, [*common, len(words) - sum(common)]


def js(p, q):
    return sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
               for a, b in zip(p, q)) / 2


def shares(hist):
    return [x / sum(hist) if sum(hist) else 0.0 for x in hist]


def test_quality_divergences_and_verdicts_by_hand(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    by_lang = defaultdict(lambda: ([], []))
    for d, r in docs.items():
        n, chars, words = histograms(r.text)
        if not got[d].base_failed:
            by_lang[r.lang][0].append(shares(chars))
            by_lang[r.lang][1].append(shares(words))
    refs = {}
    for lang, both in by_lang.items():
        refs[lang] = [shares([sorted(math.floor(x * quality.STEPS + 0.5) for x in col)[(len(col) + 1) // 2 - 1]
                              for col in zip(*hists)]) for hists in both]
    kept = 0
    for d, r in docs.items():
        n, chars, words = histograms(r.text)
        want = [js(shares(h), ref) if sum(h) and sum(ref) else 0.0
                for h, ref in zip((chars, words), refs.get(r.lang, ([0], [0])))]
        if n:
            assert abs(got[d].char_js - want[0]) < 1e-4 and abs(got[d].word_js - want[1]) < 1e-4
        odd = ((len(r.text or "") >= quality.MIN_CHARS and want[0] > quality.MAX_CHAR_JS)
               or (n >= quality.MIN_HIST_WORDS and want[1] > quality.MAX_WORD_JS))
        assert got[d].kept == (not got[d].base_failed and not odd)
        kept += got[d].kept
    assert 0 < kept < len(docs)


def test_quality_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = ({(r.doc_id, r.kept, r.char_js, r.word_js) for r in quality.judge(docs.repartition(n)).collect()}
                for n in (2, 11))
    assert one == two


def ftrl_by_hand(rows, epochs):
    """FTRL-proximal as published, one coordinate at a time, in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / (
            (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    ones = sum(y for _, y in rows)
    bias, bias_n = math.log((ones + 0.5) / (len(rows) - ones + 0.5)), 1.0
    for _ in range(epochs):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + bias))))
            for i in at:
                g = p - y
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
            bias_n += (p - y) ** 2
            bias -= toxicity.ALPHA * (p - y) / math.sqrt(bias_n)
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_equals_a_plain_version():
    rnd = random.Random(2)
    rows = []
    for _ in range(150):
        y = int(rnd.random() < 0.3)
        at = {rnd.randint(0, 60) for _ in range(8)} | ({61, 62} if y and rnd.random() < 0.8 else set())
        rows.append((np.array(sorted(at)), y))
    model = toxicity.ftrl(rows, epochs=3)
    weights, bias = ftrl_by_hand(rows, 3)
    assert dict(zip(model.index.tolist(), model.weight.tolist())).keys() == weights.keys()
    assert all(abs(w - weights[i]) < 1e-5 for i, w in zip(model.index.tolist(), model.weight.tolist()))
    assert abs(model.bias - bias) < 1e-6 and 0 < len(weights) < 63
    assert {61, 62} & set(weights) and weights.get(61, 1) > 0


def test_toxicity_learns_from_distinct_rows(spark):
    """A labelled row that repeats many times does not push others out of the fit."""
    rows = [(3, "calm words about the garden")] * 400 + [(k, f"foul rage {k}" if k % 2 else f"calm day {k}")
                                                        for k in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2 if k > 3 else 0) for k in range(3, 60)], "doc_id long, toxic int")
    full, small = (toxicity.fit(docs.repartition(3), labels, max_train=m) for m in (8192, 57))
    assert (full.index == small.index).all() and (full.weight == small.weight).all()
