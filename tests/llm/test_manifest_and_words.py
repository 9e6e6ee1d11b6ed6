"""Byte pairs, spelling variants and the Merkle manifest against plain versions and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import byte_pairs, merkle, queries, spelling
from attestry.llm.common import documents

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, ids string, word string, n long, key long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    texts = [None, "", " ", "\n\n", "x" * 3000, "word Word wörd\n" * 900, "é漢字😀", "a<|endoftext|>b", "words wordy word" * 3]
    rows = [(i, "s" if i % 2 else None, "de", len(t or ""), t, "t", "i", "w", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, "word\nword words", None, None, None, None, None)] * 2 + [(3, "", None, 1, "a\nb", None, None, "w", None, None)] * 3
    return spark.createDataFrame(rows, SCHEMA)


# ------------------------------------------------------------------ byte pairs


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    return byte_pairs.load_model()


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aab e 'st|<>\n \x1c")), max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_and_text_are_the_library_s(library, model, texts):
    coder = byte_pairs.Coder(model)
    got = [ids.tolist() for ids in coder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.decode(ids) for ids in got] == texts


def test_long_words_special_tokens_and_any_ids(library, model):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij", k=20_000)), "aaaaaaa" * 400, "ÃÂ" * 700, "<|endoftext|>" * 3 + " <|endoftext|", "don't 'LL 'll", " " * 500 + "x"]
    assert [x.tolist() for x in byte_pairs.Coder(model).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(50):  # broken UTF-8 included
        ids = [rng.randrange(50257) for _ in range(40)]
        assert byte_pairs.Coder(model).decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert byte_pairs.Coder(model).decode([999_999]) == ""


def test_every_code_point_is_classed_as_in_the_library(library, model):
    coder, cut = byte_pairs.Coder(model), library.pre_tokenizer.pre_tokenize_str
    for low in range(0, 0x110000, 0x8000):
        codes = [chr(c) for c in range(low, low + 0x8000) if not 0xD800 <= c < 0xE000]
        for probe in ("a", "!"):
            text = "".join(f"{probe}{c}{probe}\n" for c in codes)
            if text:
                assert [len(x) for x in coder.pre_tokens(text)] == [b - a for _, (a, b) in cut(text)]


def test_forgetting_changes_nothing(library, model, monkeypatch):
    monkeypatch.setattr(byte_pairs, "MEMORY", 20)
    texts = [f"word{i} and more{i % 7} text" for i in range(300)]
    coder = byte_pairs.Coder(model)
    got = [x.tolist() for low in range(0, 300, 30) for x in coder.encode(texts[low : low + 30])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_byte_pairs_query(spark, library, odd, model):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {r.doc_id: r.text for r in documents(spark, MIDDLE).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows.items()}
    got = queries.op11_byte_pairs(spark, MIDDLE).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    back = byte_pairs.encode_and_decode(odd, ["doc_id", "text", "word"], model).collect()
    assert len(back) == odd.count() and all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in back)
    assert byte_pairs.encode_and_decode(odd.limit(0), ["doc_id"], model).count() == 0


# ------------------------------------------------------------------ spelling


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def brute_variants(words):
    shorter = defaultdict(set)
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shorter[key].add(w)
    near = {w: {x for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) for x in shorter[k] if one_edit(w, x)} for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, MIDDLE).collect()]
    assert sorted(map(tuple, queries.op12_spelling_variants(spark, MIDDLE).collect())) == brute_variants(brute_words(rows))


def test_spelling_of_odd_rows(spark, odd):
    counted = spelling.word_counts(odd)
    want = brute_words([(r.doc_id, r.text) for r in odd.collect()])
    assert {r.word: r.n for r in counted.collect()} == want and want
    assert sorted(map(tuple, spelling.variants(counted).collect())) == brute_variants(want)
    assert spelling.variants(spelling.word_counts(odd.limit(0))).count() == 0


@pytest.mark.parametrize("symbols", [4, 7])
def test_edits_of_runs_ties_and_long_words(spark, symbols):
    rng = random.Random(symbols)
    words = {"".join(rng.choices("aab", k=rng.randrange(5, 9))): rng.randrange(3, 90) for _ in range(400)}
    words |= {"q" * n: 5 for n in range(5, 30)} | {"y" * 800: 9, "y" * 801: 30, "y" * 399 + "z" + "y" * 400: 3}
    words |= {"tieda": 20, "tiedb": 20, "tied": 3, "tiedc": 10}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(frame).collect())) == brute_variants(words)
    pairs = {(r.word, r.near) for r in spelling.near_pairs(frame, symbols).collect()}
    short = [w for w in words if len(w) < 100]
    assert {p for p in pairs if len(p[0]) < 100} == {(a, b) for a in short for b in short if one_edit(a, b)}


def test_long_chains_of_forms(spark):
    chain = {"a" * i + "bcde": 3 * 2**i for i in range(1, 14)}
    got = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"a" * 13 + "bcde"} and sum(r.form is not None for r in got) == 12


def test_a_very_common_form(spark):
    """One word with thousands of variants: no task gets far more than its share of keys."""
    letters = [chr(c) for c in range(0xC0, 0x100)]
    hub = "abcdefghijklmnop"
    words = {hub[:i] + c + hub[j:]: 3 for i in range(len(hub) + 1) for c in letters for j in (i, i + 1) if j <= len(hub)} | {hub: 1000}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in spelling.variants(frame).collect()}
    assert got[hub].n_near == len(words) - 1 and {r.root for r in got.values()} == {hub}
    per_key = spelling._keyed(frame, ["word"], 4, False).groupBy("key").count().agg(F.max("count")).first()[0]
    assert per_key < len(words) / 4


# ------------------------------------------------------------------ manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def brute_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, range(len(at)), strict=True):
            run = at[k] // 3
            path.append(("".join(nodes[run * 3 : at[k]]), "".join(nodes[at[k] + 1 : run * 3 + 3])))
            at[k] = run
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)))
        trees[s] = brute_tree([brute_leaf(r, r.text) for r in by_source[s]])
    root, tops = brute_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(by_source[s], trees[s][1], strict=True):
            cut = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = brute_leaf(r, r.text.replace("\n", "") if cut else r.text)
            for before, after in path + top:
                node = sha(before, node, after)
            out.append((r.doc_id, brute_leaf(r, r.text), trees[s][0], root, sha(*[h for step in path + top for h in step]), node, node == root))
    return sorted(out, key=repr)


def run_query(spark, monkeypatch, frame):
    monkeypatch.setattr(queries, "documents", lambda *_: frame)
    return sorted(map(tuple, queries.op13_merkle_manifest(spark, "").collect()), key=repr)


def test_manifest_query(spark):
    got = queries.op13_merkle_manifest(spark, MIDDLE).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(documents(spark, MIDDLE).collect())
    assert 0 < sum(not r.verified for r in got) < len(got)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest_of_odd_rows_in_blocks_of_any_size(spark, odd, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 3**digits)
    assert run_query(spark, monkeypatch, odd) == brute_manifest(odd.collect())
    # many sources of one to thirty rows, one of which holds a third of all
    rng = random.Random(digits)
    rows = [(i, f"s{rng.randrange(40) if i % 3 else 0}", None, i, f"{i}\n", *[None] * 5) for i in range(120)]
    many = spark.createDataFrame(rows, SCHEMA)
    assert run_query(spark, monkeypatch, many) == brute_manifest(many.collect())


def test_manifest_of_one_row_and_of_none(spark, odd, monkeypatch):
    one = odd.filter("doc_id = 4")
    got = run_query(spark, monkeypatch, one)
    assert got == brute_manifest(one.collect()) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha()
    assert run_query(spark, monkeypatch, odd.limit(0)) == []


def test_a_change_of_any_field_is_found(spark):
    docs = documents(spark, SMALL)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    for changed, new in [("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" ")))]:
        leaves = docs.select("doc_id", "source", merkle.row_hash([F.col(c) for c in fields]).alias("leaf"),
                             merkle.row_hash([new if c == changed else F.col(c) for c in fields]).alias("seen"))
        proved = merkle.manifest(leaves, "doc_id", keep=["seen"])
        ok = proved.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("a"), (merkle.folded(F.col("seen"), F.col("proof")) == F.col("root")).alias("b"))
        assert {tuple(r) for r in ok.collect()} == {(True, False)}
