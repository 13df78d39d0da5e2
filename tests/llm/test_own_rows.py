"""Rows that share an id, or have none, are documents of their own in every stage."""
import hashlib
import random

import pytest

from gridlens.llm import decontam, linededup, simhash
from test_queries import LOWER, WORD, _components, _removed_lines


def _rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeiourstnl") for _ in range(6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    common = [prose(12) for _ in range(6)]
    text = lambda: "\n".join(rng.choice([prose(9), prose(9), rng.choice(common), "..", ""]) for _ in range(rng.randint(1, 7)))
    rows = [(rng.choice([None, None, 1, 2, 3, k + 10, k + 10]), text()) for k in range(90)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (2, rows[5][1]), (2, rows[5][1]), (None, None), (None, ""), (3, None),
             (-(1 << 63), text()), (500, rows[0][1]), (500, text()), (1, common[0]), (None, common[0] + "\n" + prose(9))]
    return [(i, t, f"r{k}") for k, (i, t) in enumerate(rows)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, tag string").repartition(5)


def _in_order(rows):
    low = -(1 << 63)
    return sorted(rows, key=lambda r: (low if r[0] is None else r[0], r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest()))


def _line_fates():
    rows = _in_order(ROWS)
    gone, every, _ = _removed_lines([(k, t, None) for k, (_, t, _) in enumerate(rows)])
    return [(i, t, sum(d == k for d, _ in every), sorted(n for d, n in gone if d == k)) for k, (i, t, _) in enumerate(rows)]


def test_line_report(docs):
    got = [tuple(r) for r in linededup.report(docs, "doc_id", "text").select("id", "n_lines", "n_removed", "removed_lines").collect()]
    want = [(i, n, len(cut), cut) for i, _, n, cut in _line_fates()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines_cut(docs):
    want = []
    for i, t, _, cut in _line_fates():
        left = t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        if not cut or left.split():
            want.append((i, left))
    got = linededup.apply(docs, "doc_id", "text")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_one_of_each_component(docs):
    comps, group = _components(ROWS)
    best = {}
    for (i, t, _), (_, _, c), g in zip(ROWS, comps, group):
        if i == c and (g not in best or (t is not None, t or "") < (best[g][1] is not None, best[g][1] or "")):
            best[g] = (i, t)
    got = simhash.keep_one(docs, "doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(best.values(), key=repr)


def test_only_rows_with_benchmark_text_go(spark, docs):
    text = next(t for i, t, _ in ROWS if i is None and t and len(t.split()) > 20)
    item = " ".join(WORD.findall(text.translate(LOWER))[:12])
    two = next(t for i, t, _ in ROWS if i == 2 and t and len(t.split()) > 20)
    bench = spark.createDataFrame([(1, item), (2, " ".join(WORD.findall(two.translate(LOWER))[3:14]))], "item_id long, text string")
    windows = {tuple(w[k:k + 10]) for w in (r["text"].split() for r in bench.collect()) for k in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[k:k + 10]) in windows for w in [WORD.findall((t or "").translate(LOWER))] for k in range(len(w) - 9))
    want = sorted(tag for _, t, tag in ROWS if not hit(t))
    got = sorted(r["tag"] for r in decontam.drop_contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect())
    assert got == want
    assert 0 < len(want) < len(ROWS)
