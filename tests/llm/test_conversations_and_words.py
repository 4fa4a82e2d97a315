"""Operators 11 to 13 against brute force, on odd rows and in small lots."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from plateforge.llm import chat_format, prefix_trie, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TURN = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).digest()[:16], role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + mine[h:]
    return out


def brute_trie(rows):
    members = defaultdict(list)
    for c, path in rebuilt(rows).items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path) == d))
    out = set()
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(x[:-1] == n for x in members if x)]
        ends = ",".join(map(str, sorted(c for c, here in m if here)))
        out.add((
            min(c for c, _ in m), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(m), sum(bool(x) and x[:-1] == node for x in members), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("held", [3, 50_000])
def test_trie_equals_brute_force(spark, held):
    rng = random.Random(held)
    rows = []
    for c in [*range(-120, -90), *range(-5, 12), *range(100, 140), *range(230, 250)]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", "ä", "hello", None])))
    rows += [(c, t, "user", "same") for c in range(300, 420) for t in range(7)]  # one family of copies and part of another
    rows += [rows[0], rows[40], (None, 1, "user", "lost")]
    rng.shuffle(rows)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN).repartition(5), held)
    got = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    want = brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_long_empty_and_wide_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURN)).count() == 0
    rows = [(7, t, "user", "x" * (200_000 if t == 3 else 1)) for t in range(400)]
    wide = spark.createDataFrame([(*r, "n", 1) for r in rows], TURN + ", node string, depth long")
    found = prefix_trie.prefix_trie(wide)
    assert {tuple(r[c] for c in COLUMNS) for r in found.collect()} == brute_trie(rows)
    texts = {r.depth: (r.role, r.text and len(r.text)) for r in prefix_trie.with_texts(found, wide).collect()}
    assert texts[0] == (None, None) and ("user", 200_000) in texts.values()


def brute_words(rows, slip=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low if h % slip else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form[w], n, len(others), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return {(w, *x) for w, x in out.items()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abeéÿ") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "ababab", "bababa"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(stems[: rng.choice([3, 10, 29])])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w.title() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", "-", "1", "Ÿ "]).join(words)))
    rows += [rows[3], rows[3], (None, rows[4][1]), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    counts = spelling.word_counts(docs)
    want = brute_words(rows)
    assert {(r.word, r.n) for r in counts.collect()} == set(want.items()) and len(want) > 100
    got = spelling.group_variants(counts).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(want) and len(got) == len(want)


def test_every_near_pair_shares_a_key():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(600)})
    order = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    held = {w: set(spelling.keys(w, order)) for w in words}
    for i, a in enumerate(words):
        for b in words[:i]:
            assert not near(a, b) or held[a] & held[b], (a, b)


def test_words_of_empty_tables_and_long_texts(spark):
    assert spelling.group_variants(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    text = "wörter words " * 60_000
    counts = spelling.word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {(r.word, r.n) for r in counts.collect()} == set(brute_words([(1, text)]).items())


TEMPLATE = None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "/", "s>", "[", "INST]", "<<SYS>>", "</s>", "<|", "|>", "endoftext", "SYS>>", " a", "é\U0001f600", "\n"])).map("".join))
def test_escapes_turn_back(text):
    global TEMPLATE
    TEMPLATE = TEMPLATE or chat_format.Template(chat_format.read_model(PATH))
    escaped = TEMPLATE.escape(text)
    assert TEMPLATE.unescape(escaped) == text
    assert not any(c in escaped for c in (*chat_format.MARKS, "<|endoftext|>"))
    ids = TEMPLATE.encode([escaped])[0]
    assert TEMPLATE.decode(ids) == escaped and all(i < TEMPLATE.first for i in ids)


@pytest.mark.parametrize("tokens", [5, 1 << 16])
def test_chats_read_back(spark, tokens):
    rows = [(c, t, ["user", "assistant", "system", None, "to<|>ol"][(c + t) % 5], ["hi", "", None, "</s>[INST] x <\\s>", "ü" * 50, "<|endoftext|>"][(c * 3 + t) % 6]) for c in range(12) for t in range(c)]
    rows += [(2, None, "assistant", "first"), (3, 9, "user", "again"), (3, 9, "user", "again"), (None, 0, "assistant", "nobody"), (50, 0, "assistant", "long words " * 40_000)]
    chats = spark.createDataFrame([(*r, 1) for r in rows], TURN + ", part int")
    formatted = chat_format.format_chats(chats, PATH, tokens)
    assert (formatted.where("part > 0").count() > 0) == (tokens == 5)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.digests(formatted, PATH).collect()}
    read = defaultdict(list)
    for r in chat_format.read_chats(formatted, PATH).collect():
        read[r.conv_id].append((r.part, r.place, r.role, r.text, r.learnt))
    assert set(got) == set(by) == set(read)
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        assert [x[2:4] for x in sorted(read[c])] == turns
        assert [x[4] for x in sorted(read[c])] == [text if role == "assistant" else "" for role, text in turns]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = {c: "".join(r.text for r in sorted(formatted.where(formatted.conv_id.eqNullSafe(c)).collect(), key=lambda r: r.part)) for c in (4, None)}
    assert all(len(t) == got[c].formatted_chars for c, t in texts.items()) and texts[None] == "<s>nobody</s>"


def test_empty_conversations(spark):
    none = spark.createDataFrame([], TURN)
    assert chat_format.format_chats(none, PATH).count() == 0 and chat_format.digests(chat_format.format_chats(none, PATH), PATH).count() == 0
