"""Filter audit, exact dedup and the Merkle manifest against brute force: odd rows, hot
groups, forced hash collisions and spills, blocks over several tasks."""
import hashlib
import itertools
import math
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm import filteraudit, gracededup, merkle
from gridlens.llm import queries as Q
from lowered import with_constants
from test_queries import SF, clean, docs_of, odd, read, run, where  # noqa: F401

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(d):
    return [{k: (None if clean(v) is None else int(v) if k in ("doc_id", "n_chars") else v) for k, v in r.items()}
            for r in read(d, "documents")]


def _audit(docs, labels):
    """Every order played through, document by document."""
    first, out = {}, []
    for r in docs:
        t, i = r["text"] or "", r["doc_id"]
        if i is not None:
            first[t] = min(i, first.get(t, i))
    good = {x["doc_id"] for x in labels if clean(x["doc_id"]) is not None and x["quality"] == 1}
    toxic = {x["doc_id"] for x in labels if clean(x["doc_id"]) is not None and x["toxic"] == 1}
    parts = defaultdict(list)
    for r in docs:
        t, i = r["text"] or "", r["doc_id"]
        w = SPACE.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[r["source"] or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    for part, rows in parts.items():
        removals, mine = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removals[f] += len(gone)
                mine.append(["".join(order), step, len(left), len(gone), sum(f in x[0] for x in rows) - len(gone),
                             sum(x[0] == {f} for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        out += [(part, *m, removals[m[0][m[1] - 1]]) for m in mine]
    return out


def test_op11(spark, where):  # noqa: F811
    got = [tuple(r) for r in Q.QUERIES["op11_filter_audit"](spark, where).collect()]
    assert sorted(got) == sorted(_audit(rows_of(where), read(where, "labels")))


def test_lattice_counts_orders():
    for k in range(1, 6):
        edges = filteraudit.lattice(k)
        assert len(edges) == k * 2 ** (k - 1)
        assert all(n == math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) for s, _, n in edges)
        assert sum(n for s, _, n in edges if not s) == math.factorial(k)


def test_audit_of_other_filters_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 9, "h"), (2, "b B", None, 9, "h"), (2, "b B", "", 9, "h")],
                                 "id long, body string, part2 string, mask long, hash string")
    labels = spark.createDataFrame([(2, 1, 0)], "id long, good int, toxic int")
    got = filteraudit.audit(docs, "id", "body", "part2", {"short": filteraudit.few_words(2), "same": filteraudit.EARLIER_COPY},
                            labels, "id", F.col("good") == 1, F.col("toxic") == 1).collect()
    assert len(got) == 2 * 2 * 2
    assert {(r.part, r.shapley) for r in got if r.filter_order.startswith("short") and r.step == 1} == {("", 0), ("x", 2)}
    # rows of one id are no copies of each other
    assert all(r.removed == 0 for r in got if r.part == "")
    with pytest.raises(ValueError):
        filteraudit.masks(docs, "id", "body", "part2", {})


def _dedup(docs):
    groups = defaultdict(list)
    for i, t, _ in docs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


def test_op12(spark, where):  # noqa: F811
    want, n_texts = _dedup(docs_of(where))
    got = run(spark, "op12_exact_dedup", where)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n_texts == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_dedup_spills_and_flushes_of_every_size(spark):
    """Tables for one content up to all: several levels, and the same answer."""
    docs = [(i, ["", "hot", "x" * 3000, f"t{i % 37}", None][i % 5], "k") for i in range(400)] + [(None, "hot", "k")] * 7
    want, n_texts = _dedup(docs)
    frame = spark.createDataFrame(docs, "id long, text string, row string").repartition(5)
    for flush, limit in ((1, 30_000), (4000, 1 << 20), (1 << 20, 5000)):
        got = gracededup.group(frame, "id", "text", flush=flush, limit=limit).collect()
        assert sorted(((r.id, r.keep_id, r.group_size, r.sha256.hex()) for r in got), key=repr) == want
        assert sum(r.kept for r in got) == n_texts
    kept = gracededup.distinct_texts(frame, "id", "text")
    assert kept.columns == frame.columns and kept.count() == n_texts
    assert {r.row for r in kept.collect()} == {"k"}


def test_content_table_compares_contents():
    """Equal hashes of different contents stay apart, at every size of the table."""
    t = gracededup.ContentTable()
    for k in range(3000):
        assert t.add(t.find(k % 3, str(k).encode()), k % 3, str(k).encode()) == k
        if k > 600:
            continue
        assert all(t.find(j % 3, str(j).encode()) == j for j in range(0, k, 97))
    assert t.find(1, b"none") < 0 and t.find(-5, b"0") < 0


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """Root, and each leaf's runs: (siblings before, siblings after) by level."""
    paths, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        nexts, below = [], []
        for s in range(0, len(nodes), 3):
            run_ = nodes[s:s + 3]
            for j in range(len(run_)):
                for leaf in at[s + j]:
                    paths[leaf].append((run_[:j], run_[j + 1:]))
            nexts.append(_h(*run_))
            below.append([x for j in range(len(run_)) for x in at[s + j]])
        nodes, at = nexts, below
    return nodes[0], paths


def _manifest(docs):
    def leaf(r, text):
        return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    groups = defaultdict(list)
    for r in docs:
        t = r["text"]
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        groups[b"" if r["source"] is None else b"=" + r["source"].encode()].append(
            (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, t), leaf(r, t.replace("\n", "") if even and t else t), r["doc_id"]))
    trees = [(k, sorted(rows), _tree([x[2] for x in sorted(rows)])) for k, rows in sorted(groups.items())]
    root, tops = _tree([t[2][0] for t in trees]) if trees else (None, [])
    out = []
    for (_, rows, (subroot, paths)), top in zip(trees, tops):
        for (_, _, own, other, i), path in zip(rows, paths):
            node = other
            for before, after in path + top:
                node = _h(*before, node, *after)
            out.append((i, own, subroot, root, _h(*[s for b, a in path + top for s in b + a]), node, node == root))
    return sorted(out, key=repr)


def test_op13(spark, where):  # noqa: F811
    got = [tuple(r) for r in Q.QUERIES["op13_merkle_manifest"](spark, where).collect()]
    assert sorted(got, key=repr) == _manifest(rows_of(where))
    assert where != SF or {r[-1] for r in got} == {True, False}


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


@pytest.mark.parametrize("block", [9, 27])
def test_manifest_of_hot_source_in_small_blocks(spark, block):
    """Several rounds: a source over many blocks, sources that end at every place of a
    block, null ids, repeated rows."""
    sizes = {"hot": 400, None: 28, "": 1, "é": 9, "z": 10, "b": 27, "a": 2} | {f"s{k}": 1 + k % 3 for k in range(30)}
    docs, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            docs.append({"doc_id": None if i % 50 == 7 else i * 7919 % 1000003, "source": source, "lang": None, "n_chars": i % 3, "text": f"a\nb{i % 5}"})
            i += 1
    docs += [dict(docs[7])] * 3
    frame = spark.createDataFrame([(*r.values(), "clash") for r in docs], SCHEMA).repartition(7)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    with with_constants(spark, merkle, BLOCK=block, HEIGHT=round(math.log(block, 3)), _TASK_ROWS=50):
        rows = merkle.manifest(frame, "doc_id", "source", fields, F.when(even, merkle.leaf([*map(F.col, fields[:-1]), cut])))
        got = [(r.id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256, r.folded_root.hex(), r.verified)
               for r in merkle.verify(rows).collect()]
    assert sorted(got, key=repr) == _manifest(docs)


def test_frontier_extends_witnesses_as_siblings_come():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(100)]
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 80):
        tree = merkle.Frontier(height=5)
        for k, x in enumerate(leaves[:n]):
            tree.append(x)
            # a leaf whose run is closed has its siblings, one in the open run has none yet
            assert bool(tree.witness[0]) == (k >= 2) and not tree.witness[k] == (k % 3 != 2)
        root = tree.finish(alone=True)
        want, _ = _tree([x.hex() for x in leaves[:n]])
        assert root.hex() == want
        assert all(merkle.fold(x, bytes(w)) == root for x, w in zip(leaves, tree.witness))
        assert n == 1 or merkle.fold(leaves[99], bytes(tree.witness[0])) != root
