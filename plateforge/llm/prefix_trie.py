"""Prefix trie of conversations, families first (operator 11).

A family is the conversations of one hundred ids. Its turns, as digests and lengths,
are dealt to one task and sorted, the base conversation first, so every conversation
is rebuilt and walked in a stream: a task holds the base's first turns and the
family's small trie, of which it hands on what it has whenever that grows large,
because all that it says of a node adds up. Only these combined nodes are shuffled,
to be merged over all families; the root has one row a family, not one a
conversation.

Subtree sums need no walk over the merged tree. A conversation owns the nodes whose
smallest member it is; these are the end of its path, from some depth on. So a sum
over the different nodes of a subtree is a sum over the conversations through its
top, each counted from (or up to) the depth where its own nodes begin. A first pass
over the families finds that depth, a second adds up, and both merges are grouped
sums, whatever the depth of the tree.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import discard, materialise

FAMILY = 100
#: Turns that a rebuilt conversation may take from its base are fewer than this.
SHARED = 6
#: Nodes that a task holds before it hands them on, and rows of a batch.
HELD_NODES = 50_000
BATCH_ROWS = 5_000

ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_NODE = "node binary, parent binary, turn binary, depth long, conv_id long, upto long, chars long, inner boolean, n_convs long, n_leaves long, saved long, at long, ends string"
_KINDS = [pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.bool_(), *[pa.int64()] * 4, pa.string()]
_NAMES = [c.split(" ")[0] for c in _NODE.split(", ")]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): 128 bits of SHA-256 of each row's role and text, and the text's code points; null role and text are empty.

    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 32))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def shared_turns(conv_id: int) -> int:
    """How many of its base's first turns a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


class _Trie:
    """What one task knows of the nodes that it has met since it last handed them on: node -> list of the fields below."""

    PARENT, TURN, DEPTH, CONV, UPTO, CHARS, INNER, CONVS, LEAVES, SAVED, ENDS = range(11)

    def __init__(self):
        self.nodes: dict[bytes, list] = {}

    def touch(self, node, parent, turn, depth, conv, upto, chars):
        found = self.nodes.get(node)
        if found is None:
            found = self.nodes[node] = [parent, turn, depth, conv, upto, chars, False, 0, 0, 0, []]
        elif conv < found[self.CONV]:
            found[self.CONV] = conv
        found[self.CONVS] += 1
        return found

    def rows(self):
        """Arrow batches of all nodes, which are forgotten."""
        items = list(self.nodes.items())
        self.nodes = {}
        for lo in range(0, len(items), BATCH_ROWS):
            out = []
            for node, f in items[lo : lo + BATCH_ROWS]:
                ends = sorted(f[self.ENDS])
                out.append((node, *f[: self.ENDS], ends[0] if ends else None, ",".join(map(str, ends)) if ends else None))
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_NAMES)


def _walk(held: int):
    """Rows (family, conv_id, kind, turn, digest, chars, own, cut, leaf) in that order to family nodes.

    Kind 0 says of a conversation from which depth on its nodes are its own, how many
    code points lie before, and whether it stands for a leaf; kind 1 is a turn. With
    totals, a row without a node gives each conversation's code points.
    """

    def run(batches):
        trie, totals = _Trie(), []
        family = conv = None
        base: list[tuple[bytes, int]] = []
        told = node = top = None
        place = depth = upto = skip = 0

        def visit(digest, chars):
            nonlocal node, top, depth, upto
            parent, node = node, hashlib.blake2b(node + digest, digest_size=16).digest()
            top[_Trie.INNER] = True
            depth, upto = depth + 1, upto + chars
            top = trie.touch(node, parent, digest, depth, conv, upto, chars)
            count()

        def count():
            if told and (told[0] is None or depth < told[0]):
                top[_Trie.SAVED] += told[1] - upto + top[_Trie.CHARS]
                top[_Trie.LEAVES] += told[2]
            elif told:
                top[_Trie.LEAVES] += told[2]

        def begin():
            nonlocal node, top, depth, upto, skip
            node, depth, upto = ROOT, 0, 0
            top = trie.touch(ROOT, None, None, 0, conv, 0, 0)
            count()
            skip = 0 if conv == family else shared_turns(conv)
            for digest, chars in base[:skip] if conv != family else ():
                visit(digest, chars)

        def finish():
            top[_Trie.ENDS].append(conv)
            totals.append((None, None, None, depth, conv, upto, None, None, None, None, None, None, None))

        for batch in batches:
            for fam, c, kind, _, digest, chars, own, cut, leaf in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if conv is not None:
                        finish()
                    if fam != family:
                        family, base = fam, []
                    conv, place, told = c, 0, None
                    if kind == 0:
                        told = (own, cut, int(leaf))
                    begin()
                    if kind == 0:
                        continue
                if kind == 0:
                    continue
                if conv == family and place < SHARED - 1:
                    base.append((digest, chars))
                if place >= skip:
                    visit(digest, chars)
                place += 1
                if len(trie.nodes) >= held:
                    again = trie.nodes.pop(node)
                    yield from trie.rows()
                    # The node that the walk stands on is still to be told of its children and ends.
                    trie.nodes[node] = again
                if len(totals) >= BATCH_ROWS:
                    yield _batch(totals)
                    totals = []
        if conv is not None:
            finish()
        yield from trie.rows()
        if totals:
            yield _batch(totals)

    return run


def _families(turns: DataFrame, told: DataFrame | None = None, held: int = HELD_NODES) -> DataFrame:
    """The combined nodes of each family of turns; told has conv_id, own, cut and leaf."""
    none = lambda t: F.lit(None).cast(t)
    family = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    rows = turns.select(family.alias("family"), "conv_id", F.lit(1).alias("kind"), "turn", "digest", "chars", none("long").alias("own"), none("long").alias("cut"), none("boolean").alias("leaf"))
    if told is not None:
        rows = rows.unionByName(told.select(family.alias("family"), "conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("binary").alias("digest"), none("long").alias("chars"), "own", "cut", "leaf"))
    return rows.repartition("family").sortWithinPartitions("family", "conv_id", "kind", "turn", "digest").mapInArrow(_walk(held), _NODE)


def _digest(batches):
    """Rows (node, at, ends), sorted, to one SHA-256 a node; the state of one hash is all that is held."""
    node, state, out = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if len(out) >= BATCH_ROWS:
            yield rows()
            out = []
    if node is not None:
        out.append((node, state.hexdigest()))
    if out:
        yield rows()


def prefix_trie(conversations: DataFrame, held: int = HELD_NODES) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations: node, parent and turn (128-bit keys) and the counts of the contract.

    conv_id c begins with the first h turns of conversation c - pmod(c, 100), so a
    negative id's base is the largest multiple of 100 that is not above it; h is the
    CRC-32 of c's decimal text modulo 6. Turns are ordered by number, null first, and
    rows of one number by the digest of role and text; a repeated row is a turn of its
    own. Null and empty roles and texts are alike. An empty table has no node. Other
    columns are not read. A conversation of any length passes through one task as a
    stream of 40 bytes a turn; the ids that end at a node do so as lists of a family.
    """
    turns = materialise(turn_digests(conversations))
    first = materialise(_families(turns, held=held))
    nodes = first.where("node is not null").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first(F.col("upto") - F.col("chars")).alias("before"), F.max("inner").alias("inner"))
    # What a conversation owns begins at the least depth at which it is the smallest member; one that owns nothing counts up to its end.
    ends = first.where("node is null").select("conv_id", F.lit(None).cast("long").alias("depth"), F.col("upto").alias("before"), F.lit(True).alias("inner"))
    own = nodes.select("conv_id", "depth", "before", "inner").union(ends).groupBy("conv_id").agg(F.min("depth").alias("own"), F.coalesce(F.min_by("before", "depth"), F.max("before")).alias("cut"), F.max(~F.col("inner")).alias("leaf"))
    second = materialise(_families(turns, own, held).where("node is not null"))
    discard(turns, first)
    merged = materialise(
        second.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("turn", True).alias("turn"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved"))
        )
    )
    hashed = second.where("ends is not null").select("node", "at", "ends").repartition("node").sortWithinPartitions("node", "at").mapInArrow(_digest, "node binary, ends_sha256 string")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = merged.join(above, "parent", "left").join(children, "node", "left").join(hashed, "node", "left")
    return found.select(
        "node", "parent", "turn", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def with_texts(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """trie with the role and text of each node's last turn (null for the root), found by its digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 32))
    texts = conversations.select(digest.alias("turn"), role.alias("role"), text.alias("text")).groupBy("turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return trie.join(texts, "turn", "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent", "turn")


def _crc_sql(text: str) -> str:
    """CRC-32 of decimal digits, bit by bit."""
    codes = f"list_transform(range(length({text})), lambda i: ascii(substr({text}, i + 1, 1))::BIGINT)"
    step = "list_reduce(list_prepend(xor(c, x), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {step}), 4294967295::BIGINT)"


#: Nodes are the lists of their turns; each sum of a subtree meets every node below.
ORACLE_SQL = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations),
h AS (SELECT c, c - c % 100 AS b, {_crc_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
m AS (SELECT h.c, t.i, 0 AS own, md5(length(r) || ':' || r || x) AS d, length(x) AS n FROM h JOIN t ON t.c = h.b AND t.i <= h.h UNION ALL SELECT h.c, t.i, 1, md5(length(r) || ':' || r || x), length(x) FROM h JOIN t ON t.c = h.c AND t.i > h.h),
s AS (SELECT h.c, coalesce(list(d ORDER BY own, i) FILTER (d IS NOT NULL), []) AS path, coalesce(list(n ORDER BY own, i) FILTER (d IS NOT NULL), []) AS chars FROM h LEFT JOIN m ON h.c = m.c GROUP BY h.c),
p AS MATERIALIZED (SELECT c, k AS depth, array_to_string(path[1:k], '') AS key, CASE WHEN k > 0 THEN array_to_string(path[1:k - 1], '') END AS up, CASE WHEN k > 0 THEN chars[k] ELSE 0 END AS n, k = len(path) AS here FROM (SELECT *, unnest(range(len(path) + 1)) AS k FROM s)),
n AS MATERIALIZED (SELECT key, any_value(up) AS up, any_value(depth) AS depth, min(c) AS c, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (here), '')) AS ends FROM p GROUP BY key),
k AS MATERIALIZED (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT n.key, CASE WHEN n.depth = 0 THEN '' ELSE left(n.key, 32 * CAST(g AS INT)) END AS top, (n.n_convs - 1) * n.n AS saved, k.key IS NULL AS leaf FROM n LEFT JOIN k ON n.key = k.key, LATERAL (SELECT unnest(range(n.depth + 1)) AS g)),
u AS (SELECT top AS key, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (leaf) AS BIGINT) AS n_leaves FROM a GROUP BY top)
SELECT n.c AS conv_id, CAST(n.depth AS BIGINT) AS depth, o.c AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, n.ends AS ends_sha256 FROM n LEFT JOIN n o ON n.up = o.key LEFT JOIN k ON n.key = k.key JOIN u ON n.key = u.key"""
