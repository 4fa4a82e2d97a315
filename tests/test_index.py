"""Minimizers, chains and affine alignment against full tables and brute force."""

import random
import re

import pytest

from plateforge.operators import index


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def turn(t):
    return t[::-1].translate(str.maketrans("ACGT", "TGCA"))


def table(a, b):
    """Best scores by the plain three-state recursion."""
    low = -(10**9)
    h = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = [row[:] for row in h], [row[:] for row in h]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                e[i][j] = max(e[i - 1][j] - index.EXTEND, h[i - 1][j] - index.OPEN - index.EXTEND)
            if j:
                f[i][j] = max(f[i][j - 1] - index.EXTEND, h[i][j - 1] - index.OPEN - index.EXTEND)
            d = h[i - 1][j - 1] + (index.MATCH if a[i - 1] == b[j - 1] else index.MISMATCH) if i and j else 0 if not i and not j else low
            h[i][j] = max(d, e[i][j], f[i][j])
    return h


def cost(path, a, b):
    """The score of a path, and how many letters of both it takes."""
    i = j = total = 0
    for run in re.finditer(r"[=X]+|I+|D+|S+", path):
        op, n = run[0][0], len(run[0])
        if op in "=X":
            total += sum(index.MATCH if a[i + x] == b[j + x] else index.MISMATCH for x in range(n))
            i, j = i + n, j + n
        elif op == "S":
            i += n
        else:
            total -= index.OPEN + index.EXTEND * n
            i, j = i + n * (op == "I"), j + n * (op == "D")
    return total, i, j


def test_segments_are_the_best():
    r = random.Random(2)
    pairs = [(b"", b"ACG", "clip"), (b"ACG", b"", "end"), (b"ACG", b"", "whole"), (b"", b"", "whole")]
    for _ in range(300):
        b = dna(r, r.randint(0, 25))
        a = "".join(r.choice([x, x, x, x, "", x + r.choice("ACGT"), r.choice("ACGT")]) for x in b[r.randint(0, 2) : r.randint(3, 30)])
        pairs.append((a.encode(), b.encode(), r.choice(["whole", "end", "clip"])))
    for (a, b, kind), (score, path, used) in zip(pairs, index.align_segments(pairs), strict=True):
        h = table(a, b)
        assert score == {"whole": h[-1][-1], "end": max(h[-1]), "clip": max(map(max, h))}[kind]
        assert cost(path, a, b) == (score, len(a), used)


def test_minimizers_are_those_of_all_windows():
    r = random.Random(4)
    texts = [dna(r, n) for n in (0, 5, 11, 13, 15, 60, 200)] + ["ACGTN" * 20, "A" * 40]
    owner, place, seed, back = index.minimizers([t.encode() for t in texts], 7, 5)
    value = {}
    for t, p, s, b in zip(owner.tolist(), place.tolist(), seed.tolist(), back.tolist(), strict=True):
        word = texts[t][p : p + 7]
        assert value.setdefault(min(word, turn(word)), s) == s and b == (turn(word) < word)
    got = {(t, p) for t, p in zip(owner.tolist(), place.tolist(), strict=True)}
    for t, text in enumerate(texts):
        words = [min(w, turn(w)) if set(w := text[i : i + 7]) <= set("ACGT") and w != turn(w) else None for i in range(len(text) - 6)]
        for lo in range(len(words)):
            window = [i for i in range(lo, min(lo + 5, len(words))) if words[i]]
            assert not window or any((t, i) in got for i in window)
    # A read and its reverse complement have the same seeds.
    for text in texts[5:7]:
        a, b = index.minimizers([text.encode()], 7, 5), index.minimizers([turn(text).encode()], 7, 5)
        inner = lambda m: {s for s, p in zip(m[2].tolist(), m[1].tolist(), strict=True) if 5 <= p < len(text) - 12}
        assert inner(a) <= set(b[2].tolist())


def test_reads_with_long_gaps_map_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "LOT_BASES", 3000)  # several lots
    r = random.Random(8)
    refs = [(f"g{i}", dna(r, 700)) for i in range(12)]
    rows = []
    for i in range(60):
        name, text = refs[i % 12]
        start = r.randint(0, 200)
        piece = text[start : start + 400]
        change = i % 5
        if change == 1:
            piece = piece[:150] + piece[250:]  # farther than a band reaches
        elif change == 2:
            piece = piece[:200] + dna(r, 70) + piece[200:]
        elif change == 3:
            piece = "".join(x if r.random() > 0.03 else r.choice("ACGT") for x in piece)
        elif change == 4:
            piece = dna(r, 40) + piece
        rows.append(("same name", turn(piece) if i % 2 else piece, i, name, start, "old"))
    rows += [("n", None, 60, None, 0, ""), ("e", "", 61, None, 0, ""), ("x", "A" * 300, 62, None, 0, ""), ("y", dna(r, 100), 63, None, 0, "")]
    reads = spark.createDataFrame(rows, "read_name string, read_seq string, i int, own string, start int, cigar string").repartition(3)
    references = spark.createDataFrame(refs + [("poly", "A" * 500), ("none", None)], "ref_id string, ref_seq string")
    kept = index.save_index(index.build_index(references), f"file://{tmp_path}/index")
    report = index.index_report(kept, 100).first()
    assert report.cut_seeds == 1 and report.cut_places == 490 and report.places == kept.count()
    found = index.map_reads(reads, references, kept, most=100)
    assert found.columns == ["read_name", "read_seq", "i", "own", "start", *index.ADDED]
    got = {x.i: x for x in found.collect()}
    assert len(got) == len(rows)
    by_name = dict(refs)
    for _, text, i, own, start, _ in rows:
        x = got[i]
        if own is None:
            assert (x.flag, x.ref_id, x.cigar, x.read_seq) == (4, None, None, text)
            continue
        assert (x.ref_id, x.flag, x.strand) == (own, 16 if i % 2 else 0, "rev" if i % 2 else "fwd") and x.read_seq == (turn(text) if i % 2 else text)
        assert abs(x.pos - start) <= (12 if i % 5 in (3, 4) else 0)
        path = "".join(int(n) * op for n, op in re.findall(r"(\d+)([MIDS])", x.cigar)).replace("M", "=")
        assert cost(path, x.read_seq, by_name[own][x.pos :])[:2] == (x.score, len(text))
        if i % 5 < 3:
            assert x.edits == [0, 100, 70][i % 5]
        if i % 5 == 4:
            assert re.match(r"\d+S", x.cigar)
    one = index.map_reads(reads.where("i < 20"), references, kept, direction="forward", most=100)
    assert {x.strand for x in one.where("flag <> 4").collect()} == {"fwd"} and one.where("flag = 4 or score < 60").count() == 10  # chance is worth little
    with pytest.raises(ValueError):
        index.map_reads(reads, references, kept, direction="up")


def test_empty_sides(spark):
    none = spark.createDataFrame([], "ref_id string, ref_seq string")
    reads = spark.createDataFrame([("a", "ACGTACGTACGTACGT")], "read_name string, read_seq string")
    assert [x.flag for x in index.map_reads(reads, none).collect()] == [4]
    assert index.map_reads(reads.limit(0), spark.createDataFrame([("r", "ACGTTTGACCAGATTAGA")], none.schema)).count() == 0
