"""Operators that compare documents with each other, and the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from attestry.llm import components as rounds
from attestry.llm import exact_dedup, similar, simhash, suffix_dedup
from attestry.llm.common import checkpointed, documents
from attestry.llm.components import components
from attestry.llm.induced_sorting import long_repeats, suffix_order

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, fp string, root string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, repeated rows, null and empty texts, null identifiers, extra columns with names in use."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, shared = text(4000), text(90)
    near = long.split()
    near[1000] = "changed"
    rows = [
        (1, long), (2, long), (3, " ".join(near)), (4, None), (5, ""), (6, " \n"), (7, "One two"), (7, "One two"), (8, "one TWO"),
        (9, text(40) + shared + text(30)), (10, text(20) + shared), (11, shared * 3), (None, "ghost"), (None, "ghost"), (12, "ghost"),
        (13, "é" * 500), (14, "x" + "é" * 300), (15, "a" * 900), (16, text(100)),
    ]
    return spark.createDataFrame([(i, t, None, None, None, "d", 1, "f", "r", "s") for i, t in rows], SCHEMA)


def test_suffix_order_of_names():
    rng = random.Random(3)
    for _ in range(150):
        names = [rng.randrange(rng.choice([1, 2, 3, 10, 50])) for _ in range(rng.randint(1, 60))]
        kinds, coded = np.unique(names, return_inverse=True)
        assert suffix_order(coded, len(kinds)).tolist() == sorted(range(len(names)), key=lambda i: names[i:])


def brute_starts(segments, length):
    counts = Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
    return [[counts[s[i : i + length]] > 1 for i in range(max(0, len(s) - length + 1))] for s in segments]


@pytest.mark.parametrize("in_files", [False, True])
def test_long_repeats(monkeypatch, in_files):
    from attestry.llm import induced_sorting

    if in_files:
        monkeypatch.setattr(induced_sorting, "MEMORY_BYTES", 64)
    rng = random.Random(6)
    for _ in range(120):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        some = lambda n: bytes(rng.choice(letters) for _ in range(n))
        core = some(12)
        segments = [some(rng.randint(1, 40)) for _ in range(rng.randint(1, 8))] + [core + some(3), some(4) + core]
        length, at = rng.choice([1, 2, 3, 5, 8]), 0
        flags = long_repeats(segments, length)
        for s, want in zip(segments, brute_starts(segments, length), strict=True):
            assert flags[at : at + len(want)].tolist() == want
            at += len(s) + 1


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    out = []
    for body, starts in zip(data, brute_starts(data, length), strict=True):
        gone = np.zeros(len(body), dtype=bool)
        for i in np.flatnonzero(starts):
            gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((len(body), int(gone.sum()), spans, kept))
    return sorted(out)


@pytest.mark.parametrize(("length", "hot"), [(400, 20_000), (60, 20_000), (60, 0)])
def test_suffix_dedup_of_odd_rows(odd, length, hot):
    got = suffix_dedup.repeated_bytes(odd, length=length, hot_segments=hot).collect()
    want = brute_removed([r.text for r in odd.select("text").collect()], length)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    for r in got:
        assert sum(s.high - s.low for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_suffix_dedup_of_given_documents(spark):
    docs = documents(spark, SMALL)
    got = suffix_dedup.repeated_bytes(docs).collect()
    want = brute_removed([r.text for r in docs.select("text").collect()], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.repeated_bytes(docs.limit(0)).count() == 0


def test_segments_cover_every_window_once_and_follow_content():
    rng = np.random.default_rng(2)
    core = rng.integers(97, 101, 900, dtype=np.uint8).tobytes()
    for before in (b"", b"x" * 17, b"zy" * 300):
        data = before + core + before
        _, first, end = suffix_dedup.segments(data, 400)
        assert first[0] == 0 and end[-1] == len(data) - 399 and (first[1:] == end[:-1]).all()


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    """Least index reachable, by comparing all with all."""
    root = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            root[i] = min(root[j] for j, b in enumerate(values) if bin(a ^ b).count("1") <= bits)
    return root


def test_near_duplicates_of_odd_rows(odd):
    rows = odd.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    big = 1 << 60
    ids = [big if r.doc_id is None else r.doc_id for r in rows]
    groups = brute_components(prints, 3)
    least = {g: min(i for i, h in zip(ids, groups, strict=True) if h == g) for g in groups}
    want = sorted((ids[k], f"{prints[k]:016x}", least[groups[k]]) for k in range(len(rows)))
    got = simhash.near_duplicate_components(odd).collect()
    assert sorted((big if r.doc_id is None else r.doc_id, r.fingerprint, big if r.component_id is None else r.component_id) for r in got) == want
    kept = simhash.one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id if r.doc_id is not None else big for r in kept.collect()) == sorted(set(least.values()))


def test_a_repeated_identifier_with_other_text_stays_once_per_component(spark):
    rows = [(3, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (7, "one two three four five"), (7, "one two three four five")]
    kept = simhash.one_per_component(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, rows[0][1]), (7, rows[2][1])]


def test_links_connect_what_is_close(spark):
    rng = random.Random(8)
    values = {0}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            for _ in range(rng.randint(0, 4)):
                base ^= 1 << rng.randrange(64)
            values.add(base)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(values, 3)
    mine = [found.get(v, v) for v in signed]
    pairs = {(a, b) for a, b in zip(want, mine, strict=True)}
    assert len(pairs) == len(set(want)) == len(set(mine))
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in edges.collect())


def test_components_of_a_long_path_and_a_star(spark):
    path, star = [(i, i + 1) for i in range(300)], [(1000, i) for i in range(1001, 1300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_tasks_per_round_however_many_partitions_shuffles_have(spark, monkeypatch):
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    parts = []

    def noted(df):
        parts.append((out := checkpointed(df)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(rounds, "checkpointed", noted)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
        assert {r.root for r in rounds.components(edges).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the first checkpoint is that of the given links, whose number is not yet known
    assert len(parts) > 4 and max(parts[1:]) <= spark.sparkContext.defaultParallelism


def test_perfect_hash_has_no_gaps_and_checks_bytes():
    words = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    hashed = exact_dedup.PerfectHash.build(words[:3000])
    assert sorted(hashed.slots(words[:3000])) == list(range(3000))
    assert ((hashed.slots(words[3000:]) >= -1) & (hashed.slots(words[3000:]) < 3000)).all()
    assert exact_dedup.PerfectHash.build(words[:0]).slots(words[:5]).tolist() == [-1] * 5


def test_exact_dedup_of_odd_rows(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        keep = max((j for j in same if j is not None), default=None)
        want.append((str(i), str(keep), len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups_per_row(odd).collect()]
    assert sorted(got) == sorted(want)
    kept = exact_dedup.unique_rows(odd)
    assert kept.columns == odd.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t for _, t in rows})
    assert exact_dedup.groups_per_row(odd.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = documents(spark, SMALL)
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in rows.items() if t and any(map(str.isalpha, t))}
    last = {t: max(j for j in left if left[j] == t) for t in set(left.values())}
    left = {i: t for i, t in left.items() if last[t] == i}
    # near copies share four fifths of their five-word shingles; the smallest identifier of a group stays
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in left.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in words.items()}
    first = {i: i for i in left}
    for i, j in itertools.combinations(sorted(left), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and first[i] != first[j]:
            low, high = sorted((first[i], first[j]))
            first = {k: low if v == high else v for k, v in first.items()}
    left = {i: left[i] for i in set(first.values())}
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(b in norm(t) for b in items)}
    got = corpus_pipeline.run(spark, SMALL)
    assert set(docs.columns) < set(got.columns)
    assert {r.doc_id: r.decoded for r in got.collect()} == left


def test_near_stage_links_close_fingerprints(spark):
    line = "one line of seven words that repeats "
    rows = [(i, line * 200 + " ".join(f"{w}{k}" for k in range(150))) for i, w in ((4, "x"), (9, "y"))] + [(5, "some other text of no kin at all")]
    shared = [set(similar.shingles(t).tolist()) for _, t in rows[:2]]
    assert 5 * len(shared[0] & shared[1]) < 4 * len(shared[0] | shared[1])
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect()) == [4, 5]


def test_stages_keep_columns_and_odd_rows(spark, odd):
    bench = f"{SMALL}"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, bench).columns == odd.columns, name
        assert stage(spark, odd.limit(0), bench).count() == 0, name
