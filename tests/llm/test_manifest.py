import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gazette.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, node int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout=16):
    """Root of a list of nodes, and each one's siblings by level, built level by level."""
    around, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            low = p // fanout * fanout
            around[i].append(("".join(nodes[low:p]), "".join(nodes[p + 1 : low + fanout])))
            at[i] = p // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], around


def plainly(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return digest(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    sources = {}
    for r in rows:
        touched = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0
        low = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        key = (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))
        sources.setdefault(r.source, []).append((*key, leaf(r, low) if touched else key[-1]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = [(sorted(sources[s]), *tree([x[2] for x in sorted(sources[s])])) for s in order]
    root, above = tree([b[1] for b in built])
    out = []
    for (members, subroot, inner), up in zip(built, above, strict=True):
        for (known, doc_id, node, now), own in zip(members, inner, strict=True):
            for left, right in own + up:
                now = digest(left, now, right)
            out.append((doc_id if known else None, node, subroot, root, digest(*[a + b for a, b in own + up]), now, now == root))
    return out


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_against_a_tree_built_level_by_level(spark, height):
    sizes = {None: 17, "": 1, "a": 300, "b": 16, "é": 33, **{f"s{i}": 2 for i in range(20)}}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n, None if n % 13 == 0 else f"Text {n} é " + "Word " * (n % 9), "en" if n % 7 else None, source, n, "x", 1))
            n += 1
    rows += [rows[20], rows[20], (None, "A", None, "a", None, None, None), (None, "", None, "a", None, None, None), (5, "other", "en", "a", 1, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs, height)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plainly(docs.collect())))
    assert got.where("not verified").count() > 20


def test_manifest_of_a_single_row_and_of_none(spark):
    (one,) = merkle.manifest(spark.createDataFrame([(1, "lower", "en", "s", 5, None, None)], SCHEMA)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == digest()
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_a_partial_witness_grows_with_its_siblings():
    nodes = [digest(str(i)) for i in range(40)]
    stream = merkle.Appender()
    for i, node in enumerate(nodes):
        stream.append(node)
        assert len(stream.witnesses[0]) == (0 if i < 15 else 2)
    assert stream.witnesses[39] == []
    root = stream.close(None)
    assert root == tree(nodes)[0]
    assert all(merkle.folded(n, w) == root for n, w in zip(nodes, stream.witnesses, strict=True))


def test_leaves_state_absent_fields(spark):
    row = spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)
    assert merkle.leaves(row).select("node").first()[0] == digest("-----")
    assert merkle.leaves(row).where(F.col("tampered").isNotNull()).isEmpty()
