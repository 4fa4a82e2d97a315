"""The training-data operators against brute force on small tables with nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateforge.llm import ann, bpe, hmm, kernel, near_dedup, packing, quality_classifier, quality_rules, runtime, secrets, suffix_dedup, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Columns of inputs are free to bear the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit string, bands int, row string, kept string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(30, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary, 70))
    for i in range(0, n, 5):
        texts[i] = texts[i][:100] + " " + passage + " " + texts[i][100:160]
    for i in range(1, n, 6):
        parts = texts[i - 1].split(" ")
        parts[3] = "changed"
        texts[i] = " ".join(parts)
    texts += [texts[2], texts[2], "", None, " \n ", "One two", "one TWO", "a", "a\n\na\nb", "x" * 5000, "x" * 5000 + "y", texts[0] + "\n" + texts[0], "émile " * 900]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", None, "u", 1, "r", "k") for i, t in enumerate(texts)]
    rows += [rows[2], (None, "null id text", None, None, None, "u", 1, "r", "k"), (None, texts[3], None, None, None, "u", 1, "r", "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty):
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs, percent=85, bands=16).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(docs, percent=85, bands=16)
    assert kept.columns == docs.columns and kept.where("doc_id is not null").count() == len({find(i) for i in ids})


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    """Clusters that many tasks share give the same components as clusters of one task."""
    whole = sorted(map(str, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 2)
    assert sorted(map(str, near_dedup.near_duplicates(docs).collect())) == whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in runtime.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(31)}


def brute_repeats(rows, length, keep_first):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    before, out = set(), {}
    for i, t in rows:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if (w in before) if keep_first else seen[w] > 1:
                cover[p : p + length] = b"\1" * length
            before.add(w)
        out.setdefault(i, []).append(bytes(b for b, c in zip(t, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("pieces", [2000, 3, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(docs, empty, monkeypatch, keep_first, pieces):
    """Groups of any size: in one array, divided until 3 pieces are left, or divided down to single windows."""
    monkeypatch.setattr(suffix_dedup, "ARRAY_PIECES", pieces)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    if keep_first:  # rows of one doc_id count as one
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
        rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = suffix_dedup.strip_repeats(docs, keep_first=keep_first).collect()
    assert len(got) == len(rows) and got[0].row.asDict().keys() == dict.fromkeys(docs.columns).keys()
    found = {}
    for r in got:
        found.setdefault(r.row.doc_id, []).append(bytes(r.kept))
        assert r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans)
    want = brute_repeats(rows, 200, keep_first)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffix_dedup.strip_repeats(empty).count() == 0


@pytest.mark.parametrize("copies", [20, 80, 320])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_of_near_copies(spark, monkeypatch, keep_first, copies):
    """A group of near copies at 1, 4 and 16 times a size, divided alike: brute force agrees, and rows of a round stay in proportion to the copies."""
    monkeypatch.setattr(suffix_dedup, "ARRAY_PIECES", 8)
    rng = np.random.default_rng(copies)
    text = rng.integers(97, 123, 1500).astype(np.uint8)
    rows = []
    for i in range(copies):
        copy = text.copy()
        for at in rng.integers(0, 1500, 2):
            copy[at] = 65 + i % 26
        rows.append((i, copy[: rng.integers(900, 1501)].tobytes().decode()))
    sizes, real = [], suffix_dedup.materialise

    def spy(df, **options):
        found = real(df, **options)
        if df.columns == suffix_dedup._HALF_COLUMNS:
            sizes.append(found.count())
        return found

    monkeypatch.setattr(suffix_dedup, "materialise", spy)
    got = suffix_dedup.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep_first=keep_first).collect()
    want = brute_repeats([(i, t.encode()) for i, t in rows], 200, keep_first)
    assert {r.row.doc_id: [bytes(r.kept)] for r in got} == want
    assert 1 <= len(sizes) <= 8 and sum(sizes) <= 60 * copies


def test_longest_factors():
    """The arrays against their definition, on a text of few letters and at some of its positions only."""
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 260).astype(np.uint8)
    at = np.sort(rng.choice(200, 90, replace=False))
    previous, later = suffix_dedup.longest_factors(suffix_dedup.rank_levels(raw, 40), at, 40)
    text = raw.tobytes()

    def common(i, j):
        n = 0
        while n < 40 and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n if n == 40 else n // 8 * 8

    for k, i in enumerate(at):
        assert previous[k] == max([common(i, j) for j in at[:k]], default=0)
        assert later[k] == max([common(i, j) for j in at[k + 1 :]], default=0)


def test_smaller_neighbours():
    values = np.random.default_rng(2).permutation(300)
    before, after = suffix_dedup.smaller_neighbours(values)
    for i, v in enumerate(values):
        assert before[i] == max((j for j in range(i) if values[j] < v), default=-1)
        assert after[i] == min((j for j in range(i + 1, 300) if values[j] < v), default=300)


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 300).astype(np.uint8)
    rank = suffix_dedup.suffix_ranks(text, 20)
    raw = text.tobytes() + b"\0" * 20
    for i in range(0, 280, 7):
        for j in range(0, 280, 5):
            assert (rank[i] < rank[j]) == (raw[i : i + 20] < raw[j : j + 20])


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    bad = ["vile", "vilest", "rotten"]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(f"w{x}" for x in rng.integers(0, 80, 8)) + "." for _ in range(6)]
        if i % 4 == 0:
            sentences[i % 6] = f"w1 {bad[i % 3]} w2 {bad[i % 2]}."
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (1, None), (5000, 1)]
    texts, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(texts.where("doc_id < 300"), marks)
    got = toxicity.score_toxicity(texts, model).where("doc_id >= 300").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got) >= 97
    hit = next(r for r in got if r.doc_id % 4 == 0 and r.score >= 0.5)
    assert any(b in rows[hit.doc_id][1][hit.worst_start : hit.worst_end] for b in bad)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, model).count() == 0
    blank = toxicity.train(empty, marks)
    assert toxicity.drop_toxic(docs, marks.where("false")).count() == docs.count() and not blank[0].any()


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=256).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    assert sum(r.n_tokens for r in got) == sum(len(WORD.findall(r.text or "")) + 1 for r in docs.collect())
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert sum(m.n_tokens for m in members) <= 256
        kinds = [source[m.doc_id] for m in members]
        assert len(kinds) == len(set(kinds))
        assert sorted((m.bin_offset, m.bin_offset + m.n_tokens) for m in members) == sorted((sum(x.n_tokens for x in sorted(members, key=lambda m: m.bin_offset)[:i]), sum(x.n_tokens for x in sorted(members, key=lambda m: m.bin_offset)[: i + 1])) for i in range(len(members)))
    assert packing.pack(empty).count() == 0


def test_near_copies_share_no_bin(spark, tmp_path):
    """A copy with one word changed, of another source, is of the same cluster for op3_packing."""
    text = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(text), "a"), (2, " ".join([*text[:-1], "changed"]), "b"), (None, None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = {r.doc_id: r.bin_id for r in packing.op3_packing(spark, str(tmp_path)).collect()}
    assert set(bins) == {1, 2, None} and bins[1] != bins[2]


def test_best_fit_takes_the_tightest():
    rng = np.random.default_rng(3)
    items = sorted(((int(n), int(s), int(c)) for n, s, c in zip(rng.integers(1, 60, 300), rng.integers(0, 9, 300), rng.integers(0, 80, 300), strict=True)), key=lambda x: -x[0])
    bins = []
    for (size, s, c), (at, offset, left) in zip(items, packing.best_fit(items, 64), strict=True):
        fits = [64 - sum(x[0] for x in b) for b in bins if sum(x[0] for x in b) + size <= 64 and all(x[1] != s and x[2] != c for x in b)]
        if at == len(bins):
            assert not fits
            bins.append([])
        else:
            assert 64 - sum(x[0] for x in bins[at]) == min(fits) == left + size
        assert offset == sum(x[0] for x in bins[at])
        bins[at].append((size, s, c))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, docs, empty):
    weak = "Zx81kQ02bbT7yyP4mN"
    texts = ["password=abc", "é Password: 'hunter2x' token=ab token: secret=abcdefgh", "AKIA" + "Q7" * 9 + " AKIAQ", "deadbeef" * 4 + " " + "0" * 23, weak, f"user=admin {weak} https://host.example/x", f"user=admin {'z ' * 300} {weak}", "see https://host.example/x", "api_key=" + "k=" * 200, None, "", "token=abcdef " * 700]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.row.doc_id: r for r in secrets.find_secrets(rows).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in got[i].base] == sorted(want)
    assert [len(got[i].linked) for i in (4, 5, 6, 7)] == [0, 3, 0, 0]
    clean = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert clean[5].text == "[SECRET] [SECRET] [SECRET]" and clean[7].text == texts[7] and clean[9].text is None and clean[5].key == "x"
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count() and secrets.redact(empty).count() == 0


def test_linked_parts_are_those_of_all_pairs(spark):
    """The sweep against the rules over every pair of parts of a text, at and around the scope, with many parts and non-ASCII text."""
    rng = np.random.default_rng(13)
    kinds = ['token="abcdef1"', "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "user=admin", "Zx81kQ02bbT7yyP4mN", "https://host.example/x", "some.one@mail.example.com", "10.20.30.40:8080", "999.20.30.40"]
    texts = []
    for i in range(120):
        parts = []
        for _ in range(rng.integers(0, 300 if i < 3 else 7)):
            parts += [kinds[rng.integers(0, 9)], "é" * int(rng.integers(1, 60))]
        texts.append(" ".join(parts))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    patterns = {3: r"(?<!\w)user=admin", 4: "Zx81kQ02bbT7yyP4mN", 5: r"https://host\.example/x", 6: r"some\.one@mail\.example\.com", 7: r"(?<!9)10\.20\.30\.40:8080"}
    n = 0
    for r in secrets.find_secrets(frame, scope=40).collect():
        text = texts[r.row.doc_id]
        base = [tuple(s) for s in r.base]
        parts = base + [(m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, text)]
        want = []
        for p in parts:
            near = {q[1] for q in parts if q is not p and q[0] <= p[2] + 40 and q[2] >= p[0] - 40}
            key, access, labelled, mail, weak, place = near & {0, 2}, 1 in near, 3 in near, 6 in near, 4 in near, near & {5, 7}
            linked = {4: labelled or access or (mail and place), 3: key or (weak and place), 6: key or (weak and place), 5: key or access or (weak and (labelled or mail)), 7: key or access or (weak and (labelled or mail))}
            if linked.get(p[1]) and not any(b[0] < p[2] and p[0] < b[2] for b in base):
                want.append(p)
        assert [tuple(s) for s in r.linked] == sorted(want)
        n += len(want)
    assert n > 100


def test_redact_replaces_runs(spark):
    """Long and non-ASCII texts, over many pieces, against a plain loop over the spans; column names with dots pass."""
    texts = ["é🙂" * 3000 + " token=abcdefgh " + "x" * 9000 + " 10.1.2.3 " + "0" * 24, "token=abcdefgh" * 400, "password=aaaaaa token=bbbbbb", "nothing", ""]
    frame = spark.createDataFrame([(i, t, 0, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, `a.b` long")
    found = {r.row.doc_id: sorted(map(tuple, [*r.base, *r.linked])) for r in secrets.find_secrets(frame).collect()}
    got = secrets.redact(frame)
    assert got.columns == frame.columns
    for r in got.collect():
        out, upto = "", 0
        for start, _, end in found[r.doc_id]:
            if start >= upto:
                out += texts[r.doc_id][upto:start] + "[SECRET]"
            upto = max(upto, end)
        assert r.text == out + texts[r.doc_id][upto:] and r.n_chars == len(r.text) and r["a.b"] == r.doc_id


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for d in docs.collect():
        t = d.text or ""
        w = WORD.findall(t)
        if d.doc_id is None:
            continue
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_mcd_finds_outliers(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (600, 4)) @ np.diag([1, 0.5, 0.3, 0.2])
    x[:100] += [0, 6, 6, 6]
    frame = spark.createDataFrame([("k", "l", *map(float, row)) for row in np.round(x, 3)], "group string, language string, v0 double, v1 double, v2 double, v3 double")
    found = quality_rules.estimates(frame)
    p = found.first()
    assert max(abs(p[f"m_v{i}"]) for i in range(4)) < 0.3
    far = frame.join(found, frame["group"] == found["key"]).select((quality_rules._distance(*quality_rules._params()) / F.col("scale")).alias("d"), "v1").collect()
    assert np.mean([r.d > 30 for r in far if r.v1 > 3]) > 0.95 and np.mean([r.d > 30 for r in far if r.v1 < 2]) < 0.01


def test_mcd_against_all_subsets(spark):
    """Groups of 13 rows, 3 of them far off: the determinant is (nearly) the least of all cores of 10, and no far row is in the core."""
    import itertools

    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(8):
        x = np.round(rng.normal(0, 1, (13, 4)) @ rng.normal(0, 1, (4, 4)), 3)
        x[:3] += rng.choice([-40, 40], 4)
        rows += [(f"g{g}", *map(float, r)) for r in x]
        floor = np.eye(4) * quality_rules.FLOOR**2
        want[f"g{g}"] = min((np.linalg.det(np.cov(x[list(c)].T, bias=True) + floor), x[list(c)].mean(axis=0).tolist()) for c in itertools.combinations(range(13), 10))
    got = quality_rules.mcd(spark.createDataFrame(rows, "key string, v0 double, v1 double, v2 double, v3 double")).collect()
    assert len(got) == 8
    for r in got:
        det, mean = want[r.key]
        assert det * (1 - 1e-9) <= r.det <= 1.05 * det
        assert np.allclose([r[f"m_v{i}"] for i in range(4)], mean, atol=1e-6) or r.det > det


def test_quality_rules_of_small_groups(spark):
    """Each source of a few rows has an estimate of its own, near its language's: a far row goes, a near one stays, even alone in its source."""
    rng = np.random.default_rng(9)
    text = lambda mark: " ".join(f"w{x}{mark}" for x in rng.integers(0, 5000, 120))
    rows = [(i, text(""), "en", f"s{i // 3}") for i in range(150)] + [(900, text("###$$$"), "en", "lone"), (901, text(""), "en", "alone"), (902, text("|||%%%"), "en", "s3"), (903, text(""), None, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, r in got.items() if not r.kept} == {900, 902} and all(r.distance is not None for r in got.values())


def test_cut_leaves_its_tail():
    x = quality_rules.cut(1e-6)
    assert math.isclose((1 + x / 2) * math.exp(-x / 2), 1e-6, rel_tol=1e-9) and 59 < quality_rules.cut() < 61


def test_quality_classifier(spark, docs, empty):
    rng = np.random.default_rng(7)
    good = lambda: ". ".join(" ".join(f"w{x}" for x in rng.integers(0, 500, 9)) for _ in range(8))
    rows = [(i, good() if i % 3 else " | ".join(f"W{x}##" for x in rng.integers(0, 9, 60))) for i in range(600)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    stats = quality_classifier.text_statistics(texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(stats, labels)
    got = quality_classifier.score(stats, model).where("doc_id >= 400").collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got]) > 0.97
    odd = quality_classifier.score(quality_classifier.text_statistics(docs), model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality_classifier.text_statistics(empty).count() == 0
    knots, values = quality_classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([10.0, 10, 10, 10]), np.array([1.0, 4, 3, 9]))
    assert (np.diff(values) >= 0).all() and knots[0] == 0 and knots[-1] == 3


def test_language_model(docs, empty):
    held = lambda r: zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2
    rows = docs.collect()
    tokens = lambda r: [*words(r.text), "\0end"]
    counts = Counter(t for r in rows if not held(r) for t in tokens(r))
    n, v = sum(counts.values()), len(counts)
    got = hmm.score_texts(docs, toxicity.fold(folds=7) == 2).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for r in rows:
        g = by_id[r.doc_id]
        if r.doc_id is None:
            continue
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r), len(tokens(r)), sum(counts[t] > 0 for t in tokens(r)), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r)), rel_tol=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    assert hmm.score_texts(empty, toxicity.fold(folds=7) == 2).count() == 0


def test_forward_is_exact():
    """The scaled recursion equals the sum over all state paths."""
    import itertools

    import pyarrow as pa

    rng = np.random.default_rng(9)
    k, size = 2, hmm.FREQUENT + hmm.ENDINGS
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(size), k).T
    text = "aa bb aa cc"
    _, h, ending, _ = next(hmm._tokens(pa.array([text])))
    model = {"start": start, "move": move, "emit": emit, "frequent": np.zeros(0, np.int64), "known": np.zeros(0, np.int64), "mass": np.ones(hmm.ENDINGS), "n": 0, "v": 0}
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([True]), pa.array([5]), pa.array([text])], names=list("abcdefg"))
    got = next(hmm._forward(model)([batch])).column(5)[0].as_py()
    klass = hmm.FREQUENT + ending
    total = sum(start[p[0]] * emit[klass[0], p[0]] * math.prod(move[p[i - 1], p[i]] * emit[klass[i], p[i]] for i in range(1, len(h))) for p in itertools.product(range(k), repeat=len(h)))
    assert math.isclose(got, math.log10(total), rel_tol=1e-9)


def test_expected_counts_are_those_of_all_paths():
    """Two states and short texts: sums over every state path; longer texts than one step of anything, one by one and together."""
    import itertools

    rng = np.random.default_rng(10)
    k, size = 2, 7
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(size), k).T
    texts = [rng.integers(0, size, n) for n in (9, 1, 4, 9, 2)]
    first, pairs, emitted, total = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0
    for text in texts:
        paths = {p: start[p[0]] * math.prod(emit[w, s] for w, s in zip(text, p, strict=True)) * math.prod(move[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(k), repeat=len(text))}
        whole = sum(paths.values())
        total += math.log(whole)
        for p, value in paths.items():
            first[p[0]] += value / whole
            for a, b in itertools.pairwise(p):
                pairs[a, b] += value / whole
            for w, s in zip(text, p, strict=True):
                emitted[w, s] += value / whole
    (run,) = hmm.lay_out(np.concatenate(texts), np.array([len(t) for t in texts]))
    for got, want in zip(hmm.expected_counts(*run[:2], start, move, emit), (first, pairs, emitted, total), strict=True):
        assert np.allclose(got, want, rtol=1e-9)


def test_expected_counts_of_long_texts(monkeypatch):
    """Texts of hundreds of tokens: posteriors of an unscaled recursion in logarithms, whole texts in one run or in several."""
    rng = np.random.default_rng(11)
    k, size = 3, 20
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(size), k).T
    texts = [rng.integers(0, size, n) for n in (700, 65, 64, 300, 1)]
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0]
    over = lambda x: np.logaddexp.reduce(x, axis=0)
    for text in texts:
        forward = [np.log(start) + np.log(emit[text[0]])]
        for w in text[1:]:
            forward.append(over(forward[-1][:, None] + np.log(move)) + np.log(emit[w]))
        backward = [np.zeros(k)]
        for w in text[:0:-1]:
            backward.insert(0, over((np.log(move) + np.log(emit[w]) + backward[0]).T))
        whole = over(forward[-1])
        want[0] += np.exp(forward[0] + backward[0] - whole)
        for t, w in enumerate(text):
            want[2][w] += np.exp(forward[t] + backward[t] - whole)
            if t:
                want[1] += np.exp(forward[t - 1][:, None] + np.log(move) + np.log(emit[w]) + backward[t] - whole)
        want[3] += whole
    for tokens in (1 << 18, 400):
        monkeypatch.setattr(hmm, "BATCH_TOKENS", tokens)
        monkeypatch.setattr(hmm, "BATCH_TEXTS", 1)
        got = [0.0] * 4
        for run in hmm.lay_out(np.concatenate(texts), np.array([len(t) for t in texts])):
            got = [a + b for a, b in zip(got, hmm.expected_counts(*run[:2], start, move, emit), strict=True)]
        assert all(np.allclose(a, b, rtol=1e-7) for a, b in zip(got, want, strict=True))


def test_training_settles(spark):
    """The objective never falls, and the last gain is below the limit, well before the most iterations."""
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(["aa", "bb"] if i % 2 else ["cc", "dd", "ee"], 90)) for i in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sequences = runtime.materialise(frame.mapInArrow(hmm._sequences(np.zeros(0, np.int64)), hmm._SEQUENCES))
    shape, tokens = np.full(hmm.FREQUENT + hmm.ENDINGS, 1.0), 60 * 91
    *_, gained = hmm.baum_welch(sequences, shape, 3)
    assert all(b >= a - 1e-4 * abs(a) for a, b in zip(gained, gained[1:], strict=False))
    assert 2 <= len(gained) < hmm.MOST_ITERATIONS and gained[-1] - gained[-2] < hmm.SETTLED * tokens


def test_bpe(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    odd = ["it's  we'll\n\n x y  z", "<|endoftext|>a<|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaa", "日本語 🙂‍↔️ é", "\x1c\x1f \x85", "1234 5678,,,;; ''", " " * 50 + "x", "́combining"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {}
    for r in frame.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    ids = bpe.encode(frame, path)
    for r in ids.collect():
        assert r.ids in [reference.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
    assert all(r.text in texts[r.doc_id] for r in bpe.decode(ids, path).collect())
    for r in bpe.digest(frame, path).collect():
        want = [reference.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
        assert r.ids_sha256 in [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
    assert bpe.digest(empty, path).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:400:3] = x[0]
    rows = [(i, [float(v) for v in row], "e") for i, row in enumerate(x)]
    rows += [(900, None, "e"), (920, [0.0] * 24, "e"), (940, [float("nan")] * 24, "e"), (960, [None] * 24, "e"), (None, rows[1][1], "e"), rows[20]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    y, recall = x.astype(float), []
    for q, found in got.items():
        found.sort()
        score = y @ y[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(score, 12)))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(math.isclose(s, y[v] @ y[q], rel_tol=1e-12, abs_tol=1e-12) for _, v, s in found)
        recall.append(len(set(want) & {f[1] for f in found}) / 20)
    assert np.mean(recall) >= 0.9
    hot = [v for _, v, _ in got[0]]
    assert hot == list(range(100, 160, 3))
    few = ann.nearest(frame.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4 and ann.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [4000, 3])
def test_nearest_of_small_tables(spark, monkeypatch, block):
    """Where buckets hold too few, all vectors are compared: exact lists of all candidates, or of 20."""
    monkeypatch.setattr(ann, "BLOCK", block)
    x = np.random.default_rng(5).normal(size=(21, 64))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    for n in (1, 5, 15, 21):
        got = {}
        for r in ann.nearest(frame.where(F.col("vec_id") < n), F.lit(True)).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: sorted(set(range(n)) - {q}, key=lambda v: -(x[v] @ x[q])) for q in range(n) if n > 1}


def test_nearest_of_odd_lengths(spark):
    """Vectors of another length than most take no part, even where lengths add up to whole rows."""
    x = np.random.default_rng(6).normal(size=(40, 24))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(100, [1.0] * 23), (101, [1.0] * 25), (102, []), (120, [1.0] * 48)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    y = np.array([r[1] for r in rows[:40]], np.float32).astype(float)
    assert got == {q: sorted(set(range(40)) - {q}, key=lambda v: -(y[v] @ y[q]))[:3] for q in (0, 20)}


def test_full_buckets_are_divided(spark, monkeypatch):
    """A tight cloud of unlike vectors fills one bucket of each table: its parts give what the whole gives."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1, 16)) + 1e-3 * rng.normal(size=(500, 16)), rng.normal(size=(100, 16))])
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    search = lambda: sorted(map(tuple, ann.nearest(frame, F.col("vec_id") % 20 == 0).collect()))
    whole = search()
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "HELD_PAIRS", 500)
    assert search() == whole and len(whole) == 30 * 20
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert np.mean([v in np.argsort(-score[q])[:20] for q, _, v, _ in whole]) >= 0.9


def test_layout_meets_a_falling_share():
    shares = []
    for n in (2_000, 50_000, 10**6, 10**9):
        hashes, probes = ann.layout(n, 64)
        assert n / math.prod(hashes) <= 2 * ann.BUCKET_ROWS
        shares.append(probes / math.prod(hashes))
    assert shares == sorted(shares, reverse=True) and shares[-1] < shares[0] / 100


def test_kernel_blocks():
    import pyarrow as pa

    texts = ["ab cd", None, "", "x" * 50, "é f"]
    for limit in (1, 10, 1000):
        seen = []
        for lo, hi, data, offsets in kernel.blocks(pa.array(texts), limit):
            starts, ends, bounds = kernel.words(data, offsets)
            for i in range(hi - lo):
                seen.append([bytes(data[a:b]).decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)])
        assert seen == [["ab", "cd"], [], [], ["x" * 50], ["é", "f"]]
