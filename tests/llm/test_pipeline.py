"""Every stage of the pipeline against a brute-force version."""
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

import corpus_pipeline
import test_queries as B
from gridlens.llm import quality
from test_queries import SF, empty, odd, where  # noqa: F401


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, where):  # noqa: F811
    docs = spark.read.parquet(f"{where}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"], r["lang"]) for r in rows_of(docs)]
        path = f"{B.tempfile.mkdtemp(dir='/tmp')}/{name}"
        stage(spark, docs, where).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == cols
        after = sorted(((r["doc_id"], r["text"], r["lang"]) for r in rows_of(docs)), key=repr)
        assert after == sorted(EXPECT[name](before, where), key=repr), name
    last = rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, where))
    assert len(last) == docs.count()
    import base64

    import tiktoken
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r["doc_id"], bytes(np.array(enc.encode_ordinary(r["text"] or ""), "<u4").tobytes())) for r in rows_of(docs)), key=repr)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in last), key=repr) == want


def _quality(docs, _):
    f = quality.Fertility.of(P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN)
    return [d for d in docs if quality.verdict(d[1], d[2], f, quality.BANDS)[6]]


def _lines(docs, _):
    gone, _, place = B._removed_lines(docs)
    out = []
    for r, (i, t, y) in enumerate(docs):
        cut = {k for d, k in gone if d == place[r]}
        if cut and t:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
            if not t.encode().split():
                continue
        out.append((i, t, y))
    return out


def _near(docs, _):
    comps, group = B._components(docs)
    best = {}
    for (i, t, y), (_, _, c), g in zip(docs, comps, group):
        if i == c and (g not in best or (t is not None, t or "") < (best[g][1] is not None, best[g][1] or "")):
            best[g] = (i, t, y)
    return list(best.values())


def _bench(docs, where):  # noqa: F811
    split = lambda t: B.WORD.findall((t or "").translate(B.LOWER))
    items = [split(B.clean(r["text"])) for r in B.read(where, "benchmark")]
    windows = {tuple(w[k:k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    bad = {i for i, t, _ in docs if any(tuple(w[k:k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))}
    return [d for d in docs if d[0] not in bad]


EXPECT = {"quality_rules": _quality, "line_dedup": _lines, "simhash_near_dedup": _near, "benchmark_decontamination": _bench}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_alone_on_odd_and_empty_rows(spark, odd, empty, name):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)[name]
    for d in (odd, empty):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        got = rows_of(stage(spark, docs, d))
        if d == empty:
            assert got == []
        elif name in EXPECT:
            before = [(r["doc_id"], r["text"], r["lang"]) for r in rows_of(docs)]
            assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in got), key=repr) == sorted(EXPECT[name](before, d), key=repr)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    label = pd.read_parquet(f"{SF}/labels.parquet")
    assert 0 < len(kept) < 200
    assert len(kept & set(label[label.quality == 1].doc_id)) > 0
