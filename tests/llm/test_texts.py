"""Operators that work text by text: encoding, counts, languages, decontamination, licences, toxicity, URLs."""

import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import decontaminate, language_id, license_scan, pieces, queries, token_count, toxicity, url_filter
from attestry.llm.common import documents
from attestry.llm.licence_templates import TEMPLATES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "▁", "a", "  two  spaces ", "é漢字😀", "x" * 3000, "word " * 4000, "\tTab\x0bV\x0cF\r\n"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, repeated rows, null identifiers, extra columns with names in use."""
    rows = [(i, t, "de", 1.0, "s") for i, t in enumerate(ODD)] + [(3, "\n\n", None, None, None), (None, "a b c", None, None, "q")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, overlaps string")


def brute_ids(text, v):
    """Viterbi over the whole marked text, without words or a trie."""
    marked = "▁" + text.replace("▁", "\udc81").replace(" ", "▁") if text else ""
    best, size = [(0, 0)], []
    for end in range(1, len(marked) + 1):
        options = [(best[end - 1][0] + v.fallback, 0)]
        for length in range(1, min(end, v.longest) + 1):
            if (found := v.pieces.get(marked[end - length : end])) is not None:
                options.append((best[end - length][0] + found[1], length))
        best.append(max(options))
        size.append(best[-1][1])
    ids, end = [], len(marked)
    while end:
        length = size[end - 1]
        if length:
            ids.append(v.pieces[marked[end - length : end]][0])
        else:
            ids += [v.byte_ids[b] for b in reversed(marked[end - 1].replace("\udc81", "▁").encode())]
        end -= max(length, 1)
    return ids[::-1]


@given(st.lists(st.text(alphabet=st.sampled_from("ab the \n▁é漢😀.,1"), max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_encoding_equals_plain_viterbi_and_decodes_back(texts):
    v = test_encoding_equals_plain_viterbi_and_decodes_back.vocabulary
    got = pieces.SharedPrefixViterbi(v).encode(texts)
    assert [g.tolist() for g in got] == [brute_ids(t, v) for t in texts]
    assert [pieces.decode_ids(g.tolist(), v.outputs) for g in got] == texts
    assert token_count.CountingTrie(v).count(texts)[0].tolist() == [len(g) for g in got]


test_encoding_equals_plain_viterbi_and_decodes_back.vocabulary = pieces.load_vocabulary()


def test_encoding_and_counts_of_odd_rows(odd, vocabulary):
    coded = pieces.encode(odd, ["doc_id", "text", "score"], vocabulary)
    back = pieces.decode(coded, ["doc_id", "text", "score", "ids"], vocabulary, name="decoded").collect()
    assert len(back) == len(ODD) + 4 and all(r.decoded == r.text for r in back)
    assert {r.text: r.ids for r in back}[""] == [] and {r.text: r.ids for r in back}[None] is None
    counts = token_count.token_counts(odd, ["text"], vocabulary).collect()
    assert {r.text: r.n_tokens for r in counts} == {r.text: len(r.ids or []) for r in back}
    assert token_count.token_counts(odd.limit(0), ["text"], vocabulary).count() == 0


def test_a_full_trie_or_memory_changes_nothing(vocabulary, monkeypatch):
    texts = [f"word{i} and more{i % 7} text" for i in range(300)]
    want = [brute_ids(t, vocabulary) for t in texts]
    monkeypatch.setattr(pieces, "MEMORY", 20)
    monkeypatch.setattr(token_count, "TRIE_NODES", 50)
    coder, trie = pieces.SharedPrefixViterbi(vocabulary), token_count.CountingTrie(vocabulary)
    for low in range(0, 300, 30):
        part = texts[low : low + 30]
        assert [g.tolist() for g in coder.encode(part)] == want[low : low + 30]
        assert trie.count(part)[0].tolist() == [len(w) for w in want[low : low + 30]]


def test_each_prefix_of_sorted_words_is_one_node_below_its_parent():
    rng = random.Random(21)
    words = sorted({"".join(rng.choice("ab▁é😀\udc81") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"a" * 300, "ab"})
    trie = pieces.WordTrie(words)
    prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert len(trie.parent) == len(trie.characters) == len(prefixes) + 1
    spelt = [""]
    for parent, char in zip(trie.parent[1:].tolist(), trie.characters[1:].tolist(), strict=True):
        spelt.append(spelt[parent] + chr(char))
    assert set(spelt[1:]) == prefixes and [spelt[end] for end in trie.ends] == words
    # a level is one depth, so its forward scores need only those of the levels above
    for depth, (low, high) in enumerate(zip(trie.levels[:-1].tolist(), trie.levels[1:].tolist(), strict=True), 1):
        assert {len(x) for x in spelt[low:high]} == {depth}
    assert trie.levels[-1] == len(spelt)


def test_lists_decode_as_ids_one_by_one(vocabulary):
    rng = random.Random(22)
    rows = [None, [], [vocabulary.byte_ids[200]], [vocabulary.byte_ids[32]] * 2, [vocabulary.byte_ids[32], vocabulary.byte_ids[65]], None]
    for ids in (rows, [[rng.randrange(len(vocabulary.outputs)) for _ in range(9)] for _ in range(100)], [], [None]):
        got = pieces.decode_lists(pa.array(ids, pa.list_(pa.int32())), pa.array(vocabulary.outputs, pa.binary()))
        assert got.to_pylist() == [None if r is None else pieces.decode_ids(r, vocabulary.outputs) for r in ids]


def test_grams_of_all_orders_are_counted_at_once(monkeypatch):
    def brute(text):
        data, counts = f" {text} ".encode(), np.zeros(language_id.WIDTH, dtype=np.int64)
        for block, n in enumerate(language_id.ORDERS):
            for at in range(len(data) - n + 1):
                mixed = 0
                for byte, factor in zip(data[at : at + n], language_id.FACTORS.tolist(), strict=False):
                    mixed = (mixed ^ byte) * factor % 2**32
                    mixed ^= mixed >> 15
                counts[block * language_id.BUCKETS + (mixed >> 20)] += 1
        return counts

    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *args, **named: calls.append(args) or bincount(*args, **named))
    for text in ("a", "ab", "wort für wort", "é漢", "x" * 500):
        assert np.array_equal(language_id.gram_counts(text), brute(text))
    assert len(calls) == 5
    # blanks alone are one separator, which has no grams of two or three
    assert language_id.gram_counts("  1 ").sum() == 1


def test_languages(spark, odd):
    got = queries.op8_language_id(spark, MIDDLE).join(documents(spark, MIDDLE).select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = language_id.fit(documents(spark, SMALL))
    rows = language_id.predict(odd, model, ["doc_id", "text"]).collect()
    assert len(rows) == len(ODD) + 4
    for r in rows:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    nothing = language_id.fit(documents(spark, SMALL).limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    one = language_id.fit(documents(spark, SMALL).filter("lang = 'de'"))
    assert {r.lang_pred for r in language_id.predict(odd, one, ["doc_id"]).collect()} == {"und", "de"}


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_lie_apart(n):
    code = language_id.codewords(n)
    distances = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(distances) >= (1 if n == 2 else 2 if n == 3 else 4)


def test_decontamination(spark, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    swapped = [w if k % 9 else "other" for k, w in enumerate(item)]
    moved = item[:20] + ["inserted"] + item[20:]
    filler = lambda n: [word() for _ in range(n)]
    texts = {
        1: item, 2: filler(50) + swapped + filler(50), 3: moved, 4: filler(300), 5: item[:12] + filler(100),
        6: ["Seven", "short", "words,", "that", "stand", "right", "HERE"], 7: ["seven", "short", "words"], 8: filler(30) + item[10:] + filler(3),
    }
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame(
        [(7, " ".join(item)), (8, "seven short words that stand right here"), (9, "the"), (10, None), (11, ""), (None, " ".join(filler(20)))],
        "item_id long, text string",
    )
    got = {r.doc_id: r.overlaps for r in decontaminate.scan(docs, bench, ["doc_id"]).collect()}
    assert {k: [o.item_id for o in v] for k, v in got.items()} == {1: [7], 2: [7], 3: [7], 4: [], 5: [], 6: [8], 7: [], 8: [7]}
    # one more replaced token costs more than the three equal ones behind it bring
    assert (got[2][0].first_token, got[2][0].end_token) == (51, 86) and got[1][0].share == 1.0
    assert all(r.overlaps == [] for r in decontaminate.scan(odd, bench, ["doc_id"]).collect())
    assert all(r.overlaps == [] for r in decontaminate.scan(docs, bench.limit(0), ["doc_id"]).collect())


def test_decontamination_in_blocks_and_against_plain_search(spark, monkeypatch):
    docs, bench = documents(spark, MIDDLE), spark.read.parquet(f"{MIDDLE}/benchmark.parquet")
    whole = {r.doc_id: {o.item_id for o in r.overlaps} for r in decontaminate.scan(docs, bench, ["doc_id"]).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 400)
    parts = {r.doc_id: {o.item_id for o in r.overlaps} for r in decontaminate.scan(docs, bench, ["doc_id"]).collect()}
    assert whole == parts
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    plain = {r.doc_id: {i for i, t in items if t in norm(r.text)} for r in docs.collect()}
    assert plain == whole and any(plain.values())


def test_every_licence_names_itself_and_not_a_sibling():
    known = license_scan.Templates(TEMPLATES)
    for name, text in TEMPLATES.items():
        filled = f"Enä der dem. Copyright 2020 Ada.\n{text.replace('COPYRIGHT HOLDER', 'AUTHOR')}\nIechä ditz."
        assert [m[0] for m in known.matches(filled)] == [name]


def test_a_text_of_many_passages(spark):
    three = [TEMPLATES[n] for n in ("BSD-3-Clause", "LGPL-3.0-header", "MIT-notice")]
    found = license_scan.Templates(TEMPLATES).matches(" enä ditz. ".join(three * 100))
    assert [m[0] for m in found] == ["BSD-3-Clause", "LGPL-3.0-header", "MIT-notice"] * 100
    empty = license_scan.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], TEMPLATES)
    assert empty.count() == 0


def test_licences(spark, odd):
    texts = {"A": "one two three four five six", "B": "seven eight nine"}
    templates = license_scan.Templates(texts)

    def brute(text):
        words, found = re.findall(r"[^\W_]+", text.lower()), []
        for name, template in texts.items():
            wanted = template.split()
            wanted = list(zip(wanted, wanted[1:], strict=False))
            for i in range(len(words)):
                for j in range(i + 2, len(words) + 1):
                    have, left = list(zip(words[i:j], words[i + 1 : j], strict=False)), list(wanted)
                    shared = sum(1 for b in have if b in left and not left.remove(b))
                    if 2 * shared / (len(have) + len(wanted)) >= 0.8:
                        found.append((2 * shared / (len(have) + len(wanted)), i, j, name))
        chosen = []
        for d, i, j, name in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1], f[3])):
            if all(j <= a or i >= b for _, a, b, _ in chosen):
                chosen.append((d, i, j, name))
        return sorted((name, round(d, 9), i, j) for d, i, j, name in chosen)

    rng = random.Random(2)
    words = "one two three four five six seven eight nine x".split()
    for _ in range(150):
        parts = [rng.choice(["x y", "One, TWO three four five six.", "seven eight nine", "one two x four five six", rng.choice(words)]) for _ in range(5)]
        text = " ".join(parts)
        got = sorted((n, round(d, 9), i, j) for n, d, i, j in templates.matches(text))
        # overlapping choices may differ only in which of equal coefficients stays
        assert [g[:2] for g in got] == [b[:2] for b in brute(text)], text
    assert all(r.licences == [] for r in license_scan.scan(odd, ["doc_id"], texts).collect())


def test_toxicity(spark, odd):
    scored = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = scored.filter("held_out").select("score", "predicted", "toxic").toPandas()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.toxic == 1).sum() > 0.85 and hit / (held.predicted == 1).sum() > 0.9
    assert held.score.between(0, 1).all()
    labels = spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = toxicity.fit(toxicity.labelled_rows(odd, labels).withColumn("part", F.lit(1)), "part")
    assert {r.score for r in none.score(odd, ["doc_id"]).collect()} == {0.0}


def test_toxic_features_of_a_text():
    made = dict(zip(toxicity.FEATURES, toxicity.Lexicon(frozenset(), frozenset()).features("YOU 1diot! you st*pid m0ron?"), strict=True))
    assert made["near_second_person"] == 1.0 and made["obfuscated_density"] > 0 and made["capital_words"] > 0
    assert toxicity.Lexicon(frozenset(), frozenset()).features(None) == [0.0] * len(toxicity.FEATURES)


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y", "https://b.example.com/de/1#t", "https://c.org/fr/", "https://c.org/de/",
        "http://net", "http://net/", "ftp://xnet/", "http://user:p@h.net:80/a", "http://É.NET/", "a://b://c.net/", "http://1.2.3.4/x", "http://x.co.uk/\n?a",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://c.org/fr/")] * 2, "page_id long, url string")
    labels = spark.createDataFrame([(i % 16, int(i % 3 > 0), None) for i in range(40)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, url_filter.page_outcomes(labels)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path = brute_url("http://c.org/fr/" if r.page_id is None else urls[r.page_id])
        fits = [
            (len(rule), rule, action)
            for action, rule in url_filter.RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])
        ]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[1] if fits else None) and (not fits or r.verdict == max(fits)[2])
    assert {r.verdict for r in url_filter.judge(pages, url_filter.page_outcomes(labels.limit(0))).collect() if r.rule is None} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.page_outcomes(labels)).count() == 0


def test_hosts_of_one_domain_with_and_without_a_suffix(spark):
    """A numeric host is its own domain without a suffix; a name below it has the same domain with one."""
    pages = spark.createDataFrame([(1, "http://3.4/"), (2, "http://x.3.4/"), (3, "http://a.b/"), (3, "http://a.b/")], "page_id long, url string")
    for labels in ([(1, 0, 0), (2, 1, 0)], []):
        outcomes = url_filter.page_outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert sorted(r.page_id for r in url_filter.judge(pages, outcomes).collect()) == [1, 2, 3, 3]


def test_a_bad_host_is_blocked_and_an_unknown_one_follows_its_domain(spark):
    pages = [(i, f"http://h{i % 4}.{'bad' if i % 2 else 'good'}.example/{i}") for i in range(400)] + [(1000, "http://new.bad.example/")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame, url_filter.page_outcomes(labels), rules=()).collect()}
    assert got[1] == "block" and got[0] == "allow" and got[1000] in ("block", "allow")
    assert np.mean([got[i] == "block" for i in range(1, 400, 2)]) == 1.0


def test_language_decoding_against_loops(spark):
    """Margins, losses and the decision again, one n-gram, bit and codeword at a time; then a code with one bad bit."""
    docs = documents(spark, SMALL)
    model = language_id.fit(docs)
    assert np.allclose(model.trust.mean(axis=1), 1.0)
    texts = [r.text for r in docs.limit(40).collect()] + ["É à", "a" * 5000, "ß1 2 3"]

    def losses(m, text):
        counts = language_id.gram_counts(text)
        total = sum(int(c) for c in counts)
        found = []
        for row, trusted in zip(m.code, m.trust, strict=True):
            loss = 0.0
            for bit, sign in enumerate(row):
                margin = sum(int(counts[b]) * float(m.weights[b, bit]) for b in np.flatnonzero(counts)) / total**0.5
                loss += trusted[bit] * np.log1p(np.exp(-margin * sign)) if abs(margin) < 500 else trusted[bit] * max(0.0, -margin * sign)
            found.append(loss)
        return found

    for text, lang, score in zip(texts, *model.scores(texts)[:2], strict=True):
        brute = losses(model, text)
        assert lang == model.languages[int(np.argmin(brute))]
        assert score == pytest.approx(1 / sum(np.exp(min(brute) - b) for b in brute), rel=1e-3)

    # a classifier that is always wrong gets hardly a say, so decoding stays as good as before
    weights = model.weights.copy()
    weights[:, 0] *= -1
    broken = language_id.rated(replace(model, weights=weights), docs, "lang", "text")
    assert broken.trust[:, 0].max() < 0.2 < broken.trust[:, 1:].min()
    rows = [(r.text, r.lang) for r in docs.filter("lang IS NOT NULL").collect()]

    def accuracy(m):
        return sum(a == b for a, (_, b) in zip(m.scores([t for t, _ in rows])[0], rows, strict=True)) / len(rows)

    assert accuracy(broken) >= accuracy(model) - 0.01
